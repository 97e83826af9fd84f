"""Small files of each format, for tests."""

import struct


def tree_file(structs, fields, labels, blob=b"", index=(), lists=()):
    head = 56
    parts = [b"".join(struct.pack("<3I", *s) for s in structs), b"".join(struct.pack("<3I", *f) for f in fields), b"".join(x.encode().ljust(16, b"\0") for x in labels), blob,
             b"".join(struct.pack("<I", x) for x in index), b"".join(struct.pack("<I", x) for x in lists)]
    counts, at, offsets = (len(structs), len(fields), len(labels), len(blob), 4 * len(index), 4 * len(lists)), head, []
    for p, n in zip(parts, counts, strict=True):
        offsets += [at, n]
        at += len(p)
    return b"UTI V3.2" + struct.pack("<12I", *offsets) + b"".join(parts)


def item_file():
    """Tag text, Cost dword, Weight float, Name locstring, ItemList of two structs with a resref each."""
    name = struct.pack("<2I", 0xFFFFFFFF, 2) + struct.pack("<2I", 4, 4) + "Größ".encode("cp1252") + struct.pack("<2I", 0, 5) + b"Sword"
    blob = struct.pack("<I", 3) + b"tag" + struct.pack("<I", len(name)) + name + b"\x04Ab_1" + b"\x02xy"
    at_name, at_1 = 7, 7 + 4 + len(name)
    fields = [(10, 0, 0), (4, 1, 250), (8, 2, struct.unpack("<I", struct.pack("<f", 1.25))[0]), (12, 3, at_name), (15, 4, 0), (11, 5, at_1), (11, 5, at_1 + 5)]
    return tree_file([(0xFFFFFFFF, 0, 5), (0, 5, 1), (1, 6, 1)], fields, ["Tag", "Cost", "Weight", "Name", "ItemList", "Res"], blob, [0, 1, 2, 3, 4], [2, 1, 2])


def archive(entries, version=b"V1.0", types=None):
    n = len(entries)
    keys = b"".join(struct.pack("<16sIHH", name.encode(), i, kind, 0) for i, (name, kind, _) in enumerate(entries))
    start = 160 + len(keys) + 8 * n
    items, body = b"", b""
    for _, _, b in entries:
        items += struct.pack("<2I", start + len(body), len(b))
        body += b
    head = b"MOD " + version + struct.pack("<9I", 0, 0, n, 160, 160, 160 + len(keys), 124, 1, 0xFFFFFFFF)
    return head.ljust(160, b"\0") + keys + items + body


def string_table(texts):
    body, entries = b"", b""
    for t in texts:
        raw = (t or "").encode("cp1252")
        entries += struct.pack("<I16s4If", 1 if t is not None else 0, b"", 0, 0, len(body), len(raw), 0.0)
        body += raw
    return b"TLK V3.0" + struct.pack("<3I", 0, len(texts), 20 + len(entries)) + entries + body


def install_index(names):
    rows = b"".join(struct.pack("<16sHI", n.encode(), k, 0) for n, k in names)
    return b"KEY V1  " + struct.pack("<4I", 0, len(names), 64, 64) + b"\0" * 40 + rows


def dbase(columns, rows, deleted=()):
    width = 1 + sum(s for _, _, s in columns)
    head = 32 + 32 * len(columns) + 1
    out = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), head, width)
    for name, kind, size in columns:
        out += struct.pack("<11scIB15x", name.encode(), kind.encode(), 0, size)
    out += b"\r"
    for i, r in enumerate(rows):
        out += (b"*" if i in deleted else b" ") + b"".join((v if isinstance(v, bytes) else str(v).encode("cp1252")).ljust(s) for v, (_, _, s) in zip(r, columns, strict=True))
    return out
