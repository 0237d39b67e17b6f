"""A Python data source of tiles of raw RGBA slides: ``spark.read.format("raw_slide").load(path)``.

A file holds width and height as 4-byte numbers, lowest byte first, then rows of RGBA. ``path`` is one file or a folder of
``*.raw`` files on any storage that ``store`` opens. Each partition reads rows of tiles up to ``PACK`` bytes, one at least.
Filters on slide, x and y are taken over by the source: other slides are not opened, other rows of tiles have no partition,
and of a row only the columns asked for are read, by ranges. So a region of a slide of any size costs its own bytes.
Of more than ``FEW`` slides the small ones are opened by tasks alone, many by each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tilewright.sources.store import opened, put

HEAD, PIXEL = 8, 4
#: Bytes of a partition, those that opening a file counts as, and slides up to which all heads are read while planning.
PACK, OPEN, FEW = 32 << 20, 64 << 10, 1000
_END = 1 << 31


class RawSlide(DataSource):
    """Options: path, tile (edge in pixels, 512). slide is the file's name without ``.raw``."""

    @classmethod
    def name(cls) -> str:
        return "raw_slide"

    def schema(self) -> str:
        return "x int, y int, width int, height int, pixels binary, slide string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("tile", 512)))


class _Band(InputPartition):
    """A row of tiles, ``y``, of the file at ``path``, and its columns from ``x0`` to ``x1``."""

    def __init__(self, path: str, slide: str, width: int, height: int, y: int, x0: int, x1: int):
        self.path, self.slide, self.width, self.height, self.y, self.x0, self.x1 = path, slide, width, height, y, x0, x1


class _Several(InputPartition):
    """Rows of tiles, and paths of whole files."""

    def __init__(self, parts: list[_Band | str]):
        self.parts = parts


def _together(parts: Iterable[tuple[int, _Band | str]]) -> list[InputPartition]:
    """Parts with their bytes as partitions of ``PACK`` bytes."""
    groups, room = [], 0
    for size, part in parts:
        if size + OPEN > room:
            groups.append([])
            room = PACK
        groups[-1].append(part)
        room -= size + OPEN
    return [g[0] if len(g) == 1 and isinstance(g[0], _Band) else _Several(g) for g in groups]


class _Reader(DataSourceReader):
    def __init__(self, path: str, tile: int):
        self.path, self.tile = path, tile
        self.span = {"x": [0, _END], "y": [0, _END]}
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what bounds slide, x or y; hand back the rest."""
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        name = ".".join(getattr(f, "attribute", ()))
        if isinstance(f, IsNotNull) and name in ("x", "y", "slide"):
            return True
        if isinstance(f, (EqualTo, EqualNullSafe, In)) and name in ("x", "y", "slide"):
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.only[name] = self.only.get(name, values) & values
            return True
        if name in self.span and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.span[name][0] = max(self.span[name][0], f.value + isinstance(f, GreaterThan))
            return True
        if name in self.span and isinstance(f, (LessThan, LessThanOrEqual)):
            self.span[name][1] = min(self.span[name][1], f.value + isinstance(f, LessThanOrEqual))
            return True
        return False

    def _wanted(self, name: str, n: int) -> Sequence[int]:
        low, high = max(self.span[name][0], 0), min(self.span[name][1], n)
        return [v for v in sorted(self.only[name]) if v is not None and low <= v < high] if name in self.only else range(low, high)

    def _files(self) -> list[tuple[str, int]]:
        at, root = opened(self.path)
        info = at.get_file_info(root)
        every = [info] if info.type == fs.FileType.File else [i for i in at.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".raw")]
        return sorted((i.path, i.size) for i in every if _name(i.path) in self.only.get("slide", {_name(i.path)}))

    def _bands(self, at: fs.FileSystem, path: str) -> Iterator[_Band]:
        with at.open_input_file(path) as f:
            head = f.read_at(HEAD, 0)
        width, height = int.from_bytes(head[:4], "little"), int.from_bytes(head[4:], "little")
        xs, ys = self._wanted("x", -(-width // self.tile)), self._wanted("y", -(-height // self.tile))
        if len(xs):
            yield from (_Band(path, _name(path), width, height, y, min(xs), max(xs) + 1) for y in ys)

    def partitions(self) -> Sequence[InputPartition]:
        at, _ = opened(self.path)
        files = self._files()
        late = {path for path, size in files if size <= PACK} if len(files) > FEW else set()
        bands = (((b.x1 - b.x0) * self.tile**2 * PIXEL, b) for path, _ in files if path not in late for b in self._bands(at, path))
        return _together(bands) + _together((size, path) for path, size in files if path in late)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _Band):
            yield from self._read(partition)
            return
        at, _ = opened(self.path)
        for part in partition.parts:
            for band in self._bands(at, part) if isinstance(part, str) else [part]:
                yield from self._read(band)

    def _read(self, p: _Band) -> Iterator[tuple]:
        rows = min(self.tile, p.height - p.y * self.tile)
        a, b = p.x0 * self.tile, min(p.width, p.x1 * self.tile)
        row = PIXEL * (b - a)
        at = lambda r: HEAD + PIXEL * ((p.y * self.tile + r) * p.width + a)
        store, _ = opened(self.path)
        with store.open_input_file(p.path) as f:
            if b - a == p.width:  # whole rows lie together
                band = f.read_at(row * rows, at(0))
            else:
                band = b"".join(f.read_at(row, at(r)) for r in range(rows))
        wanted = self.only.get("x")
        for x in range(p.x0, p.x1):
            if wanted is None or x in wanted:
                c, d = PIXEL * (x * self.tile - a), PIXEL * (min(p.width, (x + 1) * self.tile) - a)
                yield x, p.y, (d - c) // PIXEL, rows, b"".join(band[r * row + c : r * row + d] for r in range(rows)), p.slide


def _name(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".raw")


def register(spark) -> None:
    """Make the source known to the session, and let Python sources take filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawSlide)


def write_raw(path: str, width: int, height: int, pixels: bytes) -> None:
    """A raw slide from RGBA bytes."""
    if len(pixels) != PIXEL * width * height:
        raise ValueError("pixels do not fit the size")
    at, where = opened(path)
    put(at, where, width.to_bytes(4, "little") + height.to_bytes(4, "little") + pixels)
