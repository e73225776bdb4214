"""Binary codecs: compression, image headers, fonts, packages. Plain Python, wrapped as Arrow UDFs where a Column is needed."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.pandas.functions import arrow_udf

MAX_DECODED, MAX_PARTS, MAX_PART, MAX_TOTAL = 512 << 20, 20_000, 512 << 20, 2 << 30
_STAMP = (1980, 1, 1, 0, 0, 0)


def gzip_b64(data: bytes) -> str:
    return base64.b64encode(gzip.compress(data, 9, mtime=0)).decode()


def ungzip_b64(text: str, cap: int = MAX_DECODED) -> bytes:
    d = zlib.decompressobj(31)
    out = d.decompress(base64.b64decode(text), cap + 1)
    if len(out) > cap:
        raise ValueError("decoded payload is too large")
    return out


def zip_bytes(parts: dict[str, bytes]) -> bytes:
    """A package whose bytes depend on its parts alone: sorted names, a fixed time, the same compression."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name in sorted(parts):
            info = zipfile.ZipInfo(name, _STAMP)
            info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 0
            z.writestr(info, parts[name], compresslevel=9)
    return buf.getvalue()


def safe_name(name: str) -> str:
    out: list[str] = []
    for part in name.replace("\\", "/").split("/"):
        if part == "..":
            if not out:
                raise ValueError(f"unsafe package path: {name}")
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def unzip(data: bytes, max_parts: int = MAX_PARTS, max_part: int = MAX_PART, max_total: int = MAX_TOTAL) -> dict[str, bytes]:
    """The parts of a package; sizes are checked before anything is unpacked."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > max_parts:
            raise ValueError("too many parts")
        if any(i.file_size > max_part for i in infos) or sum(i.file_size for i in infos) > max_total:
            raise ValueError("package is too large")
        parts = {safe_name(i.filename): z.read(i) for i in infos}
    if "[Content_Types].xml" not in parts:
        raise ValueError("missing [Content_Types].xml")
    return parts


def image_size(data: bytes) -> tuple[float, float, float] | None:
    """(width, height, dots per inch) of PNG, GIF, BMP, JPEG and SVG headers; SVG sizes are pixels at 96."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        w, h = struct.unpack(">II", data[16:24])
        at, dpi = 8, 96.0
        while at + 12 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"pHYs" and n == 9 and data[at + 16] == 1:
                dpi = struct.unpack(">I", data[at + 8 : at + 12])[0] * 0.0254 or 96.0
            if kind in (b"IDAT", b"IEND"):
                break
            at += 12 + n
        return w, h, dpi
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return (*struct.unpack("<HH", data[6:10]), 96.0)
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h), 96.0
    if data[:2] == b"\xff\xd8":
        at, dpi = 2, 96.0
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if marker == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0" and data[at + 11] in (1, 2):
                x = struct.unpack(">H", data[at + 12 : at + 14])[0]
                dpi = (x * (2.54 if data[at + 11] == 2 else 1)) or 96.0
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(data):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h, dpi
            at += 2 + n
        return None
    if data.lstrip()[:1] == b"<" and (m := re.search(r"<svg\b[^>]*>", data.decode("utf-8", "replace"))):
        per = {"": 1.0, "px": 1.0, "pt": 96 / 72, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}
        get = lambda k: re.search(rf'\b{k}="\s*([\d.]+)\s*(px|pt|in|cm|mm)?\s*"', m[0])
        w, h, box = get("width"), get("height"), re.search(r'viewBox="([^"]+)"', m[0])
        if w and h:
            return float(w[1]) * per[w[2] or ""], float(h[1]) * per[h[2] or ""], 96.0
        if box and len(v := re.split(r"[\s,]+", box[1].strip())) == 4:
            return float(v[2]), float(v[3]), 96.0
    return None


def fitted_points(data: bytes, width: float | None, height: float | None) -> tuple[float, float] | None:
    """Size in points: what isn't given follows the image's own ratio."""
    own = image_size(data)
    if own is None or not own[0] or not own[1]:
        return (width, height) if width and height else None
    w, h = own[0] * 72 / own[2], own[1] * 72 / own[2]
    if width and height:
        return width, height
    if width:
        return width, width * h / w
    return (height * w / h, height) if height else (w, h)


def media_type(filename: str, data: bytes) -> str | None:
    """By the first bytes, else by the extension."""
    # First bytes and extensions of image types.
    for start, kind in ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff")):
        if data.startswith(start):
            return kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    by_name = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "emf": "image/x-emf", "wmf": "image/x-wmf"}
    return by_name.get(filename.rpartition(".")[2].lower())


def font_names(data: bytes) -> tuple[list[str], list[str]]:
    """(family names, style names) of sfnt and collection files, from name ids 1, 16, 21 and 2, 17, 22."""
    offsets = [0]
    if data[:4] == b"ttcf":
        n = struct.unpack(">I", data[8:12])[0]
        offsets = list(struct.unpack(f">{n}I", data[12 : 12 + 4 * n]))
    families: dict[str, None] = {}
    styles: dict[str, None] = {}
    for at in offsets:
        tables = struct.unpack(">H", data[at + 4 : at + 6])[0]
        for k in range(tables):
            tag, _, start, _ = struct.unpack(">4sIII", data[at + 12 + 16 * k : at + 28 + 16 * k])
            if tag != b"name":
                continue
            _, count, strings = struct.unpack(">HHH", data[start : start + 6])
            for r in range(count):
                platform, _, _, name_id, size, off = struct.unpack(">6H", data[start + 6 + 12 * r : start + 18 + 12 * r])
                raw = data[start + strings + off : start + strings + off + size]
                text = raw.decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace").strip("\0 ")
                if text and name_id in (1, 16, 21):
                    families[text] = None
                elif text and name_id in (2, 17, 22):
                    styles[text] = None
    return list(families), list(styles)


def font_extension(data: bytes) -> str:
    return {b"OTTO": ".otf", b"ttcf": ".ttc", b"wOFF": ".woff", b"wOF2": ".woff2"}.get(data[:4], ".ttf")


def deobfuscate_font(data: bytes, key: str) -> bytes:
    """An embedded font with its first 32 bytes decoded by the reversed GUID."""
    guid = bytes.fromhex(re.sub(r"[^0-9A-Fa-f]", "", key))[::-1]
    if len(guid) != 16:
        raise ValueError("a font key is a GUID")
    return bytes(b ^ guid[i % 16] for i, b in enumerate(data[:32])) + data[32:]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def gzip_b64_column(data: Column) -> Column:
    @arrow_udf("string")
    def coded(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else gzip_b64(x) for x in data.to_pylist()], pa.string())

    return coded(data.cast("binary"))


def image_size_column(data: Column) -> Column:
    """struct(width, height, dpi)."""

    @arrow_udf("struct<width: double, height: double, dpi: double>")
    def sized(data: pa.Array) -> pa.Array:
        found = [image_size(x) if x else None for x in data.to_pylist()]
        return pa.array([f and dict(zip(("width", "height", "dpi"), map(float, f), strict=True)) for f in found], pa.struct([(k, pa.float64()) for k in ("width", "height", "dpi")]))

    return sized(data)
