"""Attachments: what their bytes show without unpacking or running them."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib

MAX_NAMES = 200
ARCHIVES = ("zip", "rar", "7z", "gz", "tar", "iso", "img", "cab")
CFB = bytes.fromhex("D0CF11E0A1B11AE1")
_ACTIVE = re.compile(rb"(?is)<script\b|javascript:|\bon(?:load|error|click|mouseover)\s*=|<(?:iframe|object|embed|form)\b")
_NAMED = re.compile(rb"(?i)\.(?:html?|shtml|hta|svg)$")


def extension(name: str) -> str:
    return m.group(1).lower() if (m := re.search(r"\.([^./\\]*)$", name.strip())) else ""


def zip_names(data: bytes) -> tuple[list[str], bool]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            return [i.filename for i in infos[:MAX_NAMES]], any(i.flag_bits & 1 for i in infos)
    except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError, struct.error):
        return [], False


def _vint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while at < len(data) and shift < 63:
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            break
    return out, at


def rar_names(data: bytes) -> tuple[list[str], bool]:
    """Names and encryption of RAR archives of both generations, from their headers only."""
    names: list[str] = []
    if data.startswith(b"Rar!\x1a\x07\x01\x00"):
        at = 8
        while at + 7 < len(data) and len(names) < MAX_NAMES:
            size, start = _vint(data, at + 4)
            end = start + size
            kind, p = _vint(data, start)
            if kind == 4:
                return names, True
            flags, p = _vint(data, p)
            extra = body = 0
            if flags & 1:
                extra, p = _vint(data, p)
            if flags & 2:
                body, p = _vint(data, p)
            if kind == 2:
                file_flags, p = _vint(data, p)
                _, p = _vint(data, p)
                _, p = _vint(data, p)
                p += 4 * bool(file_flags & 2) + 4 * bool(file_flags & 4)
                _, p = _vint(data, p)
                _, p = _vint(data, p)
                n, p = _vint(data, p)
                names.append(data[p : p + n].decode("utf-8", "replace"))
                if extra and b"\x01" == data[end - extra + 1 : end - extra + 2]:
                    return names, True
            if size <= 0 or kind == 5:
                break
            at = end + body
        return names, False
    if data.startswith(b"Rar!\x1a\x07\x00"):
        at, locked = 7, False
        while at + 7 <= len(data) and len(names) < MAX_NAMES:
            _, kind, flags, size = struct.unpack_from("<HBHH", data, at)
            if size < 7:
                break
            body = struct.unpack_from("<I", data, at + 7)[0] if flags & 0x8000 and at + 11 <= len(data) else 0
            if kind == 0x73 and flags & 0x80:
                return names, True
            if kind == 0x74 and at + 32 <= len(data):
                n = struct.unpack_from("<H", data, at + 26)[0]
                first = at + 32 + 8 * bool(flags & 0x100)
                names.append(data[first : first + n].split(b"\0")[0].decode("utf-8", "replace"))
                locked |= bool(flags & 4)
            at += size + body
        return names, locked
    return names, False


class CutShort(ValueError):
    """A compound file in which a chain of sectors ends before its contents do."""


def cfb_entries(data: bytes, whole: bool = False) -> dict[str, bytes | None]:
    """Names of a compound file's directory and the contents of its streams; nothing of a broken file.

    ``whole``: a chain of sectors that ends too soon is an error, else what there is of it comes out.
    """
    if not data.startswith(CFB) or len(data) < 512:
        return {}
    try:
        sector = 1 << struct.unpack_from("<H", data, 30)[0]
        mini = 1 << struct.unpack_from("<H", data, 32)[0]
        dir_at, cutoff, mini_at = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
        read = lambda n: data[(n + 1) * sector : (n + 2) * sector]
        fat: list[int] = []
        difat = [x for x in struct.unpack_from("<109I", data, 76) if x < 0xFFFFFFFA]
        at, seen = struct.unpack_from("<I", data, 68)[0], set()
        while at < 0xFFFFFFFA and at not in seen:  # the FAT's sectors that the header has no room for
            seen.add(at)
            *more, at = struct.unpack(f"<{sector // 4}I", read(at).ljust(sector, b"\xff"))
            difat += [x for x in more if x < 0xFFFFFFFA]
        for n in difat:
            fat += struct.unpack(f"<{sector // 4}I", read(n).ljust(sector, b"\xff"))

        def chain(n: int, table: list[int]) -> list[int]:
            out: list[int] = []
            while n < len(table) and len(out) <= len(table):
                out.append(n)
                n = table[n]
            if whole and n != 0xFFFFFFFE and (out or n < 0xFFFFFFFA):
                raise CutShort(f"a chain of {len(out)} sectors has no end")
            return out

        def cut(content: bytes, size: int, name: str) -> bytes:
            if whole and len(content) < size:
                raise CutShort(f"{name} has {len(content)} of {size} bytes")
            return content[:size]

        directory = b"".join(map(read, chain(dir_at, fat)))
        mini_fat = [x for n in chain(mini_at, fat) for x in struct.unpack(f"<{sector // 4}I", read(n).ljust(sector, b"\xff"))] if mini_at < 0xFFFFFFFA else []
        out: dict[str, bytes | None] = {}
        root = b""
        parents: dict[int, str] = {}
        records = [directory[i : i + 128] for i in range(0, len(directory) - 127, 128)]
        info = []
        for r in records:
            n = struct.unpack_from("<H", r, 64)[0]
            info.append((r[: max(0, n - 2)].decode("utf-16-le", "replace"), r[66], *struct.unpack_from("<III", r, 68), struct.unpack_from("<I", r, 116)[0], struct.unpack_from("<I", r, 120)[0]))
        if info:
            root = b"".join(map(read, chain(info[0][5], fat)))
        stack = [(info[0][4], "")] if info else []
        while stack:
            i, prefix = stack.pop()
            if i >= len(info) or i in parents:
                continue
            name, kind, left, right, child, start, size = info[i]
            parents[i] = path = f"{prefix}{name}"
            stack += [(left, prefix), (right, prefix)]
            if kind == 1:
                out[path] = None
                stack.append((child, f"{path}/"))
            elif size < cutoff:
                out[path] = cut(b"".join(root[k * mini : (k + 1) * mini] for k in chain(start, mini_fat)) if size else b"", size, path)
            else:
                out[path] = cut(b"".join(map(read, chain(start, fat))), size, path)
        return out
    except CutShort:
        raise
    except (struct.error, IndexError, ValueError):
        return {}


def seven_zip_locked(data: bytes) -> bool:
    """Whether a 7z archive's header names the encryption method; the names themselves are packed."""
    return data.startswith(b"7z\xbc\xaf\x27\x1c") and b"\x06\xf1\x07\x01" in data


def describe(name: str, mime: str, data: bytes) -> dict:
    """One attachment as the mail record holds it."""
    ext = extension(name)
    names: list[str] = []
    locked = macro = False
    is_zip = data[:4] in (b"PK\x03\x04", b"PK\x05\x06")
    archive = ext in ARCHIVES or is_zip or data.startswith((b"Rar!", b"7z\xbc\xaf"))
    if is_zip:
        names, locked = zip_names(data)
        if any(n.lower().endswith("vbaproject.bin") for n in names):
            macro = True
        if "[Content_Types].xml" in names:
            archive, names = False, []
    elif data.startswith(b"Rar!"):
        names, locked = rar_names(data)
    elif data.startswith(b"7z\xbc\xaf"):
        locked = seven_zip_locked(data)
    elif data.startswith(CFB):
        own = [n.lower().rsplit("/", 1)[-1] for n in cfb_entries(data)]
        macro = any(n in ("vba", "dir", "project", "projectwm") or n.startswith("_vba_project") for n in own)
    active = bool((_NAMED.search(name.encode("utf-8", "replace")) or mime == "text/html") and _ACTIVE.search(data))
    return {"name": name, "mime": mime, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "ext": ext, "macro_detected": macro, "is_archive": archive, "password_protected": locked, "nested_names": names, "has_active_content": active}


_PDF_TEXT = re.compile(rb"\(((?:\\.|[^\\()]){1,400})\)\s*(?:Tj|')")


def read_pdf(data: bytes) -> tuple[str, list[str], dict]:
    """(text, URLs, features) of a PDF, of what stands in it uncompressed or deflated."""
    streams = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            streams.append(zlib.decompressobj().decompress(m.group(1), 1 << 20))
        except zlib.error:
            pass
    raw = b"\n".join([data, *streams])
    text = "\n".join(t.decode("latin-1").replace("\\(", "(").replace("\\)", ")") for t in _PDF_TEXT.findall(raw)[:400])
    urls = list(dict.fromkeys(u.decode("latin-1") for u in re.findall(rb"https?://[^\s<>()\"']+", raw)))
    low = raw.lower()
    return text, urls, {"javascript": b"/javascript" in low or b"/js " in low or b"/js(" in low, "open_action": b"/openaction" in low or b"/aa" in low, "launch": b"/launch" in low, "form": b"/acroform" in low, "embedded": b"/embeddedfile" in low, "pages": raw.count(b"/Type /Page") + raw.count(b"/Type/Page")}


def read_png(data: bytes) -> dict | None:
    """Size and three commonest colours of a PNG of 8 bits a channel; of others only what the header tells."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n") or len(data) < 33:
        return None
    width, height, depth, kind = struct.unpack_from(">IIBB", data, 16)
    out = {"mime": "image/png", "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "phash": None, "colors": [], "width": width, "height": height}
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or not channels or data[28] or width * height > 40_000_000:
        return out
    import numpy as np

    at, packed = 8, b""
    while at + 8 <= len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        if tag == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += 12 + n
    try:
        raw = zlib.decompress(packed)
    except zlib.error:
        return out
    stride = width * channels
    if len(raw) < height * (stride + 1):
        return out
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    prior = np.zeros(stride, np.int32)
    pixels = np.empty((height, width, channels), np.uint8)
    for y in range(height):
        f, line = int(rows[y, 0]), rows[y, 1:].astype(np.int32)
        if f == 2:
            line = (line + prior) & 255
        elif f in (1, 3, 4):
            cur = line.tolist()
            up = prior.tolist()
            for i in range(stride):
                a = cur[i - channels] if i >= channels else 0
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + up[i]) // 2
                else:
                    c = up[i - channels] if i >= channels else 0
                    pa_, pb_, pc_ = abs(up[i] - c), abs(a - c), abs(a + up[i] - 2 * c)
                    p = a if pa_ <= pb_ and pa_ <= pc_ else up[i] if pb_ <= pc_ else c
                cur[i] = (cur[i] + p) & 255
            line = np.array(cur, np.int32)
        prior = line
        pixels[y] = line.reshape(width, channels).astype(np.uint8)
    rgb = pixels[..., :3] if channels >= 3 else np.repeat(pixels[..., :1], 3, 2)
    alpha = pixels[..., -1] if channels in (2, 4) else np.full((height, width), 255, np.uint8)
    step = max(1, int((width * height / 40_000) ** 0.5))
    seen = (rgb[::step, ::step][alpha[::step, ::step] >= 128] // 16).astype(np.int64) * 17
    values, counts = np.unique(seen[:, 0] << 16 | seen[:, 1] << 8 | seen[:, 2], return_counts=True)
    top = sorted(zip(-counts, values))[:3]
    out["colors"] = [f"#{v:06x}" for _, v in top]
    return out
