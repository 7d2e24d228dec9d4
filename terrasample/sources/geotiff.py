"""GeoTIFF files, read into tile tables and written from arrays, after the public TIFF 6 and GeoTIFF specifications.

A file is read block by block: the header by one task from the file's first
kilobytes, and each output tile by the task that makes it, which reads only the
strips or blocks that the tile touches, by ranges.  Where windows say which tiles
they need, no others are read.  Stores that only Spark can open are read whole,
file by file (``binaryFile``).  Classic and big files (over 4 GB), strips and
tiles, planar or interleaved samples, no compression, deflate, LZW or PackBits,
and predictors 1 to 3 are understood.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import replace
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.functions.grid import Header
from terrasample.sources.raster import Raster
from terrasample.sources.shared import ship

# Fixed values of the TIFF and GeoTIFF formats: tag numbers, type sizes, compression codes.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT, SCALE, TIE, MATRIX, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
TAKEN, ITEMS = 306, 42112
_CODES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}


#: Bytes that are read at once for a header.
HEAD = 1 << 16
Reader = Callable[[int, int], bytes]


def _ranged(uri: str) -> Reader:
    """Reads (offset, size) of a file in a store that Arrow knows; the first HEAD bytes are kept."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    f = store.open_input_file(path)
    head = f.read_at(min(HEAD, f.size()), 0)

    def read(at: int, size: int) -> bytes:
        return head[at : at + size] if at + size <= len(head) else f.read_at(size, at)

    return read


def _reader(data: bytes | Reader) -> Reader:
    return data if callable(data) else lambda at, size: data[at : at + size]


def _tags(data: bytes | Reader) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first directory."""
    read = _reader(data)
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack_from(order + "H", start, 2)[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    # offsets, counts of entries and sizes of an entry's own value: 4, 2 and 4 bytes, or all 8
    word, count, room = ("Q", "Q", 8) if magic == 43 else ("I", "H", 4)
    at = struct.unpack_from(order + word, start, 8 if magic == 43 else 4)[0]
    n = struct.unpack(order + count, read(at, struct.calcsize(count)))[0]
    entry = struct.Struct(order + "HH" + word)
    each, first = entry.size + room, at + struct.calcsize(count)
    entries = read(first, each * n)
    out: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, many = entry.unpack_from(entries, each * k)
        if kind not in _TYPES:
            continue
        form = order + _TYPES[kind] * many
        size, value = struct.calcsize(form), entries[each * k + entry.size : each * (k + 1)]
        raw = value[:size] if size <= room else read(struct.unpack(order + word, value)[0], size)
        v = struct.unpack(form, raw)
        out[tag] = (b"".join(v).rstrip(b"\0").decode("latin-1"),) if kind == 2 else v
    return order, out


def _unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first; 256 clears, 257 ends."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = bits >> held & (1 << width) - 1
            bits &= (1 << held) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpackbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + n + 2])
            at += n + 2
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


_DECODE = {"none": bytes, "deflate": zlib.decompress, "lzw": _unlzw, "packbits": _unpackbits}


def header_of(data: bytes | Reader) -> Header:
    """Size, affine, system, bands, type and nodata of a file."""
    return _header(_tags(data)[1])


def details(data: bytes | Reader) -> tuple[Header, dict[str, str]]:
    """The header, its bands named as the file describes them, and what else the file says of itself: its metadata items and, as datetime, when it was taken."""
    from xml.etree import ElementTree

    tags = _tags(data)[1]
    header, found = _header(tags), {}
    names = list(header.bands)
    if TAKEN in tags:
        found["datetime"] = tags[TAKEN][0]
    if ITEMS in tags:
        try:
            items = list(ElementTree.fromstring(tags[ITEMS][0]))
        except ElementTree.ParseError:
            items = []  # no items, then
        for item in items:
            name, sample = item.get("name", ""), item.get("sample")
            if sample is None:
                found[name] = item.text or ""
            elif name == "DESCRIPTION" and sample.isdigit() and int(sample) < len(names) and item.text:
                names[int(sample)] = item.text
    return (replace(header, bands=tuple(names)) if len(set(names)) == len(names) else header), found


def _header(t: dict[int, tuple]) -> Header:
    a, e, c, f, b, d = 1.0, -1.0, 0.0, 0.0, 0.0, 0.0
    if MATRIX in t:
        m = t[MATRIX]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    elif SCALE in t and TIE in t:
        sx, sy, (i, j, _, x, y, _) = t[SCALE][0], t[SCALE][1], t[TIE][:6]
        a, e, c, f = sx, -sy, x - i * sx, y + j * sy
    crs = None
    if keys := t.get(GEO_KEYS):
        found = {keys[4 + 4 * k]: keys[7 + 4 * k] for k in range(keys[3])}
        crs = found.get(3072) or found.get(2048)
    n = t.get(SAMPLES, (1,))[0]
    nodata = None
    if NODATA in t:
        nodata = float(t[NODATA][0].strip())
    bands = tuple(f"b{k + 1}" for k in range(n))
    # bands of different types have a common one that keeps all their values
    return Header(t[WIDTH][0], t[HEIGHT][0], a, e, c, f, b, d, crs, bands, (nodata,) * n, str(np.result_type(*_kinds(t))))


def _kinds(t: dict[int, tuple]) -> list[np.dtype]:
    """The type of each band."""
    n = t.get(SAMPLES, (1,))[0]
    forms, bits = (v * n if len(v) < n else v for v in (t.get(FORMAT, (1,)), t.get(BITS, (1,))))
    return [np.dtype({1: "uint", 2: "int", 3: "float"}[f] + str(b)) for f, b in zip(forms[:n], bits[:n], strict=True)]


class Blocks:
    """The strips or blocks of a file, decoded one by one."""

    def __init__(self, data: bytes | Reader):
        self.read = _reader(data)
        order, t = _tags(data)
        self.header = _header(t)
        self.tiled = TILE_AT in t
        self.bands = t.get(SAMPLES, (1,))[0]
        self.kinds = [k.newbyteorder(order) for k in _kinds(t)]
        code = t.get(COMPRESSION, (1,))[0]
        if code not in _CODES:
            raise ValueError(f"unsupported compression {code}")
        self.unpack = _DECODE[_CODES[code]]
        self.planar, self.predictor = t.get(PLANAR, (1,))[0] == 2, t.get(PREDICTOR, (1,))[0]
        h = self.header.height
        if len(set(self.kinds)) > 1 and not self.planar:
            raise ValueError("bands of different types that aren't stored apart")
        self.width, self.height = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if self.tiled else (self.header.width, min(h, t.get(STRIP_ROWS, (h,))[0]))
        self.places, self.sizes = (t[TILE_AT], t[TILE_BYTES]) if self.tiled else (t[STRIP_AT], t[STRIP_BYTES])
        self.across, self.down = -(-self.header.width // self.width), -(-h // self.height)

    def block(self, i: int, j: int, band: int) -> np.ndarray:
        """Rows x columns x samples (one, if they are planar) of the block in row i, column j."""
        n, w = 1 if self.planar else self.bands, self.width
        k = i * self.across + j + (band * self.across * self.down if self.planar else 0)
        rows = self.height if self.tiled else min(self.height, self.header.height - i * self.height)
        kind = self.kinds[band]
        raw = self.unpack(self.read(self.places[k], self.sizes[k]))[: rows * w * n * kind.itemsize]
        if self.predictor == 3:  # bytes of the samples of a row by significance, then differences
            x = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, kind.itemsize * w, n), 1, dtype=np.uint8).reshape(rows, kind.itemsize, w * n)
            return np.ascontiguousarray(x.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, w, n)
        x = np.frombuffer(raw, kind).reshape(rows, w, n)
        return np.cumsum(x, 1, dtype=kind.newbyteorder("=")) if self.predictor == 2 else x

    def window(self, r0: int, r1: int, c0: int, c1: int, bands: list[int] | None = None) -> np.ndarray:
        """Bands x rows x columns of a part of the file, of the blocks that it touches only."""
        bands = list(range(self.bands)) if bands is None else bands
        out = np.zeros((len(bands), r1 - r0, c1 - c0), np.dtype(self.header.dtype))
        for i in range(r0 // self.height, -(-r1 // self.height)):
            for j in range(c0 // self.width, -(-c1 // self.width)):
                y0, x0 = i * self.height, j * self.width
                x = None
                for k, band in enumerate(bands):
                    if x is None or self.planar:
                        x = self.block(i, j, band)
                    a, b, c, d = max(r0, y0), min(r1, y0 + x.shape[0]), max(c0, x0), min(c1, x0 + x.shape[1])
                    out[k, a - r0 : b - r0, c - c0 : d - c0] = x[a - y0 : b - y0, c - x0 : d - x0, 0 if self.planar else band]
        return out


def decode(data: bytes | Reader) -> np.ndarray:
    """All samples: bands x rows x columns."""
    b = Blocks(data)
    return b.window(0, b.header.height, 0, b.header.width)


def encode(values: np.ndarray, header: Header, items: dict[str, str] | None = None) -> bytes:
    """A little-endian, deflated, band-interleaved file of one strip per 64 rows; all bands share type and nodata.

    With ``items`` the file has them as metadata, and the bands' names as descriptions.
    """
    n, h, w = values.shape
    kind = values.dtype.newbyteorder("<")
    rows = 64
    strips = [zlib.compress(np.ascontiguousarray(values[:, i : i + rows].transpose(1, 2, 0)).astype(kind).tobytes(), 6) for i in range(0, h, rows)]
    code = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (kind.itemsize * 8,) * n), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (STRIP_AT, 4, ()), (SAMPLES, 3, (n,)), (STRIP_ROWS, 4, (rows,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (1,)), (FORMAT, 3, (code,) * n),
    ]
    if header.rotated:
        tags.append((MATRIX, 12, (header.a, header.b, 0.0, header.c, header.d, header.e, 0.0, header.f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    else:
        tags += [(SCALE, 12, (header.a, -header.e, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, header.c, header.f, 0.0))]
    if header.crs:
        model = 2 if header.crs == 4326 else 1
        tags.append((GEO_KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, 2048 if model == 2 else 3072, 0, 1, header.crs)))
    if header.nodata[0] is not None:
        tags.append((NODATA, 2, (f"{header.nodata[0]:.17g}".encode() + b"\0",)))
    if items is not None:
        own = [f'<Item name={quoteattr(k)}>{escape(v)}</Item>' for k, v in items.items()]
        own += [f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(b)}</Item>' for k, b in enumerate(header.bands)]
        tags.append((ITEMS, 2, (f"<GDALMetadata>{''.join(own)}</GDALMetadata>".encode() + b"\0",)))
    tags.sort()
    at = 8 + 2 + 12 * len(tags) + 4
    body, entries = b"", []
    first_strip = None
    sizes = []
    for tag, kind_of, v in tags:
        raw = v[0] if kind_of == 2 else struct.pack("<" + _TYPES[kind_of] * len(v), *v)
        sizes.append(4 * len(strips) if tag == STRIP_AT else len(raw))
    first_strip = at + sum(s + s % 2 for s in sizes if s > 4)
    for (tag, kind_of, v), size in zip(tags, sizes, strict=True):
        if tag == STRIP_AT:
            v = tuple(first_strip + sum(map(len, strips[:k])) for k in range(len(strips)))
        raw = v[0] if kind_of == 2 else struct.pack("<" + _TYPES[kind_of] * len(v), *v)
        entry = struct.pack("<HHI", tag, kind_of, len(raw) if kind_of == 2 else len(v))
        if size <= 4:
            entries.append(entry + raw.ljust(4, b"\0"))
        else:
            entries.append(entry + struct.pack("<I", at + len(body)))
            body += raw + b"\0" * (size % 2)
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(entries) + b"\0" * 4 + body + b"".join(strips)


def _tile_arrays(x: np.ndarray, size: int, nodata: tuple[float | None, ...]) -> list[pa.Array]:
    """Each band of a tile's part, padded to size x size, as a list array of one row; what is missing is null."""
    out = []
    for band, missing in zip(x.astype(np.float64), nodata, strict=True):
        whole = np.full((size, size), np.nan)
        whole[: band.shape[0], : band.shape[1]] = band
        flat = whole.reshape(-1)
        none = ~np.isfinite(flat) | (flat == missing if missing is not None else False)
        out.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, mask=none)))
    return out


def _head(files: DataFrame) -> tuple[str, Header, bool]:
    """The path and header of the first of some files (path) and whether files can be read by ranges; read by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    found = pickle.dumps(header_of(_ranged(path)))
                except (OSError, ValueError, pa.ArrowInvalid) as e:
                    if isinstance(e, ValueError) and not isinstance(e, pa.ArrowInvalid):
                        raise
                    found = None  # a store that Arrow doesn't know
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found], pa.binary())], names=["path", "header"])

    row = files.orderBy("path").select("path").limit(1).mapInArrow(run, "path string, header binary").first()
    if row is None:
        raise FileNotFoundError("no raster file there")
    path = row["path"]
    if row["header"] is not None:
        return path, pickle.loads(bytes(row["header"])), True

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(header_of(content.as_py()))], pa.binary())], names=["header"])

    row = files.sparkSession.read.format("binaryFile").load(path).select("content").mapInArrow(whole, "header binary").first()
    return path, pickle.loads(bytes(row["header"])), False


def read(spark: SparkSession, path: str, *, size: int = 256, image_id: str | None = None, errors: str = "raise") -> Raster:
    """A raster of one file (or of files that share grid and bands, told apart by image_id, the file's name).

    ``errors``: "skip" leaves out tiles that can't be read (and files of another
    grid), "raise" fails.
    """
    ship(spark)
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(path) from e
    first, header, ranged = _head(files)
    many = image_id is not None
    name_of = F.element_at(F.split("path", "/"), -1)
    keys = [*(["image_id"] if many else []), "tile_row", "tile_col"]
    rows, cols = -(-header.height // size), -(-header.width // size)

    def fits(own: Header, name: str) -> None:
        if (own.width, own.height, len(own.bands)) != (header.width, header.height, len(header.bands)):
            raise ValueError(f"{name} has another grid than the first file")

    def tiles(units: DataFrame, bands: list[str]) -> DataFrame:
        """The tiles of units with some bands: (path, tile_row, tile_col), or (path, content) of whole files."""
        picked = [header.bands.index(b) for b in bands]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, own = None, None  # the last file
            for batch in batches:
                for k, path in enumerate(batch.column(0).to_pylist()):
                    places = [
                        (batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                    ] if ranged else [(i, j) for i in range(rows) for j in range(cols)]
                    for i, j in places:
                        try:
                            if path != name:
                                name, own = path, None
                                own = Blocks(_ranged(path) if ranged else batch.column(1)[k].as_py())
                                fits(own.header, path)
                            if own is None:
                                raise ValueError(f"{path} can't be read")
                            x = own.window(i * size, min(header.height, (i + 1) * size), j * size, min(header.width, (j + 1) * size), picked)
                        except (OSError, ValueError, IndexError, KeyError, struct.error, zlib.error):
                            if errors != "skip":
                                raise
                            continue
                        ids = [pa.array([path.rsplit("/", 1)[-1]])] if many else []
                        arrays = _tile_arrays(x, size, tuple(own.header.nodata[b] for b in picked))
                        yield pa.RecordBatch.from_arrays([*ids, pa.array([i], pa.int32()), pa.array([j], pa.int32()), *arrays], names=[*keys, *bands])

        schema = ", ".join([*(["image_id string"] if many else []), "tile_row int, tile_col int", *(f"{b} array<double>" for b in bands)])
        return units.mapInArrow(run, schema)

    fetch = None
    if ranged:
        def fetch(needed: DataFrame, bands: list[str]) -> DataFrame:
            inside = needed.where(F.col("tile_row").between(0, rows - 1) & F.col("tile_col").between(0, cols - 1))
            units = inside.join(files.select("path", name_of.alias("image_id")), "image_id") if many else inside.withColumn("path", F.lit(first))
            return tiles(_in_order(units.select("path", "tile_row", "tile_col")), bands)

        each = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("u"))
        # the tiles of one row share its strips, so a task gets all of them
        units = each.select("path", F.floor(F.col("u") / cols).cast("int").alias("tile_row"), (F.col("u") % cols).cast("int").alias("tile_col"))
        units = _in_order(units)
    else:
        units = files.select("path", "content")
    every = tiles(units, list(header.bands))
    return Raster(
        replace(header, nodata=(None,) * len(header.bands)), every, size,
        meta={"path": path, "nodata": header.nodata, "dtype": header.dtype}, fetch=fetch
    )


def _in_order(units: DataFrame) -> DataFrame:
    """Units by file and row of tiles, so that a task opens a file once and reads what shares strips one after the other."""
    n = units.sparkSession.sparkContext.defaultParallelism * 4
    return units.repartition(n, "path", "tile_row").sortWithinPartitions("path", "tile_row", "tile_col")


def write_tiles(rows: DataFrame, header: Header) -> DataFrame:
    """One file per row of (name, epsg, left, top, a, e, height, width, o, values) as a table name, content, error.

    ``values`` has an array for each band: the numbers at the places ``o`` (row-major).
    What is null or at no place is nodata: the header's, or the type's own if it has none that fits.
    A row that can't be encoded has a null content and says why in ``error``.
    """
    ship(rows.sparkSession)
    kind, n = np.dtype(header.dtype), len(header.bands)
    whole = np.iinfo(kind) if kind.kind in "iu" else None
    fill = header.nodata[0]
    if fill is None or whole and not (float(fill).is_integer() and whole.min <= fill <= whole.max):
        fill = synthetic_nodata(header.dtype)

    def file(places: pa.Scalar, values: pa.Scalar, height: int, width: int, **frame: float) -> bytes:
        x = np.full((n, height * width), np.nan)
        if values.is_valid and places.is_valid:
            at = places.values.to_numpy(zero_copy_only=False)
            for k, band in enumerate(values.values):
                x[k, at] = band.values.to_numpy(zero_copy_only=False)  # null is NaN
        none = np.isnan(x)
        if whole:
            y = np.clip(np.floor(np.where(none, 0, x) + 0.5), whole.min, whole.max).astype(kind)
            y[none] = min(int(fill), whole.max)
        else:
            y = np.where(none, fill, x).astype(kind)
        turn = {} if frame["turned"] else {"b": 0.0, "d": 0.0}
        own = replace(
            header, width=width, height=height, a=frame["a"], e=frame["e"], c=frame["left"], f=frame["top"],
            crs=frame["epsg"], nodata=(fill,) * n, **turn
        )
        return encode(y.reshape(n, height, width), own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = batch.select(["height", "width", "epsg", "left", "top", "a", "e", "turned"]).to_pylist()
            out, errors = [], []
            for o, v, f in zip(batch.column("o"), batch.column("values"), frames, strict=True):
                try:
                    out.append(file(o, v, **f))
                    errors.append(None)
                except Exception as e:  # whatever is wrong with this row, the others have their files
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=["name", "content", "error"])

    return rows.mapInArrow(run, "name string, content binary, error string")


def summary(files: DataFrame) -> DataFrame:
    """name, nodata, n_missing and total (of the first band's other values) of files (name, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                nodata, x = header_of(content.as_py()).nodata[0], decode(content.as_py())[0].astype(np.float64)
                missing = np.isnan(x) if nodata is None or nodata != nodata else x == nodata
                out.append({"name": name, "nodata": nodata, "n_missing": int(missing.sum()), "total": float(x[~missing].sum())})
            yield pa.RecordBatch.from_pylist(
                out,
                pa.schema([("name", pa.string()), ("nodata", pa.float64()), ("n_missing", pa.int64()), ("total", pa.float64())])
            )

    return files.select("name", "content").mapInArrow(run, "name string, nodata double, n_missing bigint, total double")


def synthetic_nodata(dtype: str) -> float:
    """NaN for floats, the largest value for integers, else 0."""
    k = np.dtype(dtype)
    return float("nan") if k.kind == "f" else float(np.iinfo(k).max) if k.kind in "iu" else 0.0
