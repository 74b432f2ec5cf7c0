"""A reader and a writer of the HDF5 file format, in Python alone, over any seekable file.

Written from the public format specification. The reader takes superblocks 0
to 3, both kinds of object headers, groups kept in symbol tables or as compact
links, compact, contiguous and chunked data, the shuffle, deflate and checksum
filters, numbers, enumerations, fixed and variable strings, flat compounds. What
it doesn't take (dense groups and attributes, newer chunk indexes, other
filters) raises ``Unsupported`` with the name of the feature. The writer makes
files of superblock 0 with contiguous data, which any HDF5 library reads.

Files are opened through ``pyarrow.fs``, so paths may be local or URIs of any
file system that it knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
from pyarrow import fs

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NONE = 0xFFFFFFFFFFFFFFFF


class Unsupported(ValueError):
    """A feature of the format that this reader doesn't take."""


class Damaged(ValueError):
    """A file that isn't HDF5, or ends too early."""


def open_input(path: str) -> BinaryIO:
    """A seekable file for reading, from a local path or a URI."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def open_output(path: str) -> BinaryIO:
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    parent = at.rsplit("/", 1)[0]
    if parent and parent != at:
        system.create_dir(parent, recursive=True)
    return system.open_output_stream(at)


def _pad8(n: int) -> int:
    return -n % 8


class _Type:
    """A datatype: how many bytes an element has, and how to make values of them."""

    def __init__(self, raw: bytes):
        self.kind, self.version = raw[0] & 15, raw[0] >> 4
        self.bits = int.from_bytes(raw[1:4], "little")
        self.size = struct.unpack_from("<I", raw, 4)[0]
        props = raw[8:]
        order = ">" if self.bits & 1 else "<"
        self.base: _Type | None = None
        self.names: dict[int, str] = {}
        self.used = 8
        if self.kind == 0:
            self.dtype = np.dtype(f"{order}{'i' if self.bits & 8 else 'u'}{self.size}")
            self.used += 4
        elif self.kind == 1:
            self.dtype = np.dtype(f"{order}f{self.size}")
            self.used += 12
        elif self.kind == 3:
            self.dtype = np.dtype(f"S{self.size}")
        elif self.kind == 6:
            n, at, members = self.bits & 0xFFFF, 0, []
            for _ in range(n):
                end = props.index(b"\0", at)
                name, at = props[at:end].decode(), end + 1 if self.version >= 3 else at + (end - at + 1) + _pad8(end - at + 1)
                width = 4 if self.version < 3 else max(1, (self.size.bit_length() + 7) // 8)
                offset, at = int.from_bytes(props[at : at + width], "little"), at + width + (28 if self.version == 1 else 0)
                member = _Type(props[at:])
                members.append((name, member.dtype, offset))
                at += member.used
            self.dtype = np.dtype({"names": [m[0] for m in members], "formats": [m[1] for m in members], "offsets": [m[2] for m in members], "itemsize": self.size})
            self.used += at
        elif self.kind == 8:
            self.base = _Type(props)
            self.dtype = self.base.dtype
            n, at, names = self.bits & 0xFFFF, self.base.used, []
            for _ in range(n):
                end = props.index(b"\0", at)
                names.append(props[at:end].decode())
                at = end + 1 if self.version >= 3 else at + (end - at + 1) + _pad8(end - at + 1)
            values = np.frombuffer(props, self.dtype, n, at)
            self.names = {int(v): k for v, k in zip(values, names)}
            self.used += at + n * self.base.size
        elif self.kind == 9:
            self.base = _Type(props)
            self.text = self.bits & 15 == 1
            self.dtype = np.dtype("V16")
            self.used += self.base.used
        else:
            raise Unsupported(f"datatype of class {self.kind}")

    @property
    def is_bool(self) -> bool:
        return set(self.names.values()) == {"FALSE", "TRUE"}


def _space(raw: bytes) -> tuple[int, ...] | None:
    """The shape; ``()`` for a scalar, None for an empty space."""
    version, rank = raw[0], raw[1]
    if version == 1:
        return struct.unpack_from(f"<{rank}Q", raw, 8)
    if version == 2:
        return None if raw[3] == 2 else struct.unpack_from(f"<{rank}Q", raw, 4)
    raise Unsupported(f"dataspace of version {version}")


class Node:
    """A group or a dataset."""

    def __init__(self, file: File, name: str, address: int):
        self.file, self.name = file, name
        self._held = list(file._messages(address))
        self._of = {}
        for kind, body in self._held:
            self._of.setdefault(kind, body)

    @property
    def attrs(self) -> dict[str, Any]:
        if any(k == 0x15 and struct.unpack_from("<Q", b, 4 if b[1] & 1 else 2)[0] != NONE for k, b in self._held):
            raise Unsupported(f"dense attributes of {self.name}")
        return dict(self.file._attribute(b) for k, b in self._held if k == 0x0C)

    @property
    def is_group(self) -> bool:
        return 0x08 not in self._of

    # -- groups

    def _links(self) -> dict[str, int]:
        if 0x11 in self._of:
            tree, heap = struct.unpack_from("<QQ", self._of[0x11])
            return dict(sorted(self.file._symbols(tree, self.file._heap(heap))))
        if 0x02 in self._of:
            info = self._of[0x02]
            if struct.unpack_from("<Q", info, 10 if info[1] & 1 else 2)[0] != NONE:
                raise Unsupported(f"dense links of {self.name}")
        return dict(sorted(x for x in (self.file._link(b) for k, b in self._held if k == 0x06) if x))

    def keys(self) -> list[str]:
        return list(self._links()) if self.is_group else []

    def __contains__(self, path: str) -> bool:
        return self.get(path) is not None

    def get(self, path: str) -> Node | None:
        node = self
        for part in path.strip("/").split("/"):
            links = node._links() if node.is_group else {}
            if part not in links:
                return None
            node = Node(self.file, f"{node.name.rstrip('/')}/{part}", links[part])
        return node

    def __getitem__(self, path: str) -> Node:
        node = self.get(path)
        if node is None:
            raise KeyError(f"{path!r} isn't in {self.name!r}")
        return node

    def items(self) -> Iterator[tuple[str, Node]]:
        for k, at in self._links().items() if self.is_group else ():
            yield k, Node(self.file, f"{self.name.rstrip('/')}/{k}", at)

    # -- datasets

    @property
    def shape(self) -> tuple[int, ...]:
        return _space(self._of[0x01]) or ()

    @property
    def dtype(self) -> np.dtype:
        return _Type(self._of[0x03]).dtype

    def read(self, start: int | None = None, stop: int | None = None) -> Any:
        """The values; ``start`` and ``stop`` take a part of the first axis, and only its bytes are read."""
        kind, space, layout = _Type(self._of[0x03]), _space(self._of[0x01]), self._of[0x08]
        if space is None:
            return None
        lo, hi, _ = slice(start, stop).indices(space[0]) if space else (0, 1, 1)
        hi = max(lo, hi)
        shape = (hi - lo, *space[1:]) if space else ()
        row = kind.size * int(np.prod(space[1:], dtype=np.int64)) if space else kind.size
        if layout[0] == 3 and layout[1] == 0:
            raw = layout[4 + lo * row : 4 + hi * row]
        elif layout[0] == 3 and layout[1] == 1:
            at = struct.unpack_from("<Q", layout, 2)[0]
            raw = bytes((hi - lo) * row) if at == NONE else self.file._at(at + lo * row, (hi - lo) * row)
        elif layout[0] == 3 and layout[1] == 2:
            raw = self._chunked(kind, space, layout, lo, hi)
        else:
            raise Unsupported(f"data layout {layout[0]}.{layout[1]} of {self.name}")
        values = self.file._values(kind, raw, int(np.prod(shape, dtype=np.int64)))
        return values[0] if shape == () else values.reshape(shape)

    def _chunked(self, kind: _Type, space: tuple[int, ...], layout: bytes, lo: int, hi: int) -> bytes:
        rank = layout[2] - 1
        tree, *size = struct.unpack_from(f"<Q{rank}I", layout, 3)
        filters = self.file._filters(self._of[0x0B]) if 0x0B in self._of else []
        out = np.zeros((hi - lo, *space[1:]), dtype=f"V{kind.size}")
        for at, n, mask, offset in self.file._chunks(tree, rank) if tree != NONE else ():
            if offset[0] >= hi or offset[0] + size[0] <= lo:
                continue
            raw = self.file._at(at, n)
            for i, (which, _) in reversed(list(enumerate(filters))):
                if mask >> i & 1:
                    continue
                if which == 1:
                    raw = zlib.decompress(raw)
                elif which == 2:
                    raw = np.frombuffer(raw, np.uint8).reshape(kind.size, -1).T.tobytes()
                elif which == 3:
                    raw = raw[:-4]
                else:
                    raise Unsupported(f"filter {which} of {self.name}")
            block = np.frombuffer(raw, f"V{kind.size}", int(np.prod(size))).reshape(size)
            first = max(lo, offset[0])
            into = [slice(first - lo, min(hi, offset[0] + size[0]) - lo)] + [slice(o, min(o + s, d)) for o, s, d in zip(offset[1:], size[1:], space[1:])]
            part = [slice(first - offset[0], min(hi, offset[0] + size[0]) - offset[0])] + [slice(0, min(s, d - o)) for o, s, d in zip(offset[1:], size[1:], space[1:])]
            out[tuple(into)] = block[tuple(part)]
        return out.tobytes()


class File(Node):
    """An open file; a context manager, and its root group."""

    def __init__(self, path: str):
        self._f = open_input(path)
        try:
            head = self._at(0, 96)
            if head[:8] != SIGNATURE:
                raise Damaged(f"{path} isn't an HDF5 file")
            version = head[8]
            if version in (0, 1):
                if head[13] != 8 or head[14] != 8:
                    raise Unsupported("offsets or lengths that aren't of eight bytes")
                root = struct.unpack_from("<Q", head, (56 if version == 0 else 60) + 8)[0]
            elif version in (2, 3):
                root = struct.unpack_from("<Q", head, 36)[0]
            else:
                raise Unsupported(f"superblock {version}")
            self._heaps: dict[int, bytes] = {}
            self._collections: dict[int, dict[int, bytes]] = {}
            super().__init__(self, "/", root)
        except Exception:
            self._f.close()
            raise

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_: object) -> None:
        self._f.close()

    def _at(self, address: int, n: int) -> bytes:
        self._f.seek(address)
        out = self._f.read(n)
        if len(out) < n and address:
            raise Damaged(f"the file ends before byte {address + n}")
        return bytes(out).ljust(n, b"\0")

    def _messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        head = self._at(address, 16)
        if head[:4] != b"OHDR":
            size = struct.unpack_from("<I", head, 8)[0]
            blocks = [(address + 16, size)]
            while blocks:
                at, n = blocks.pop(0)
                raw, i = self._at(at, n), 0
                while i + 8 <= n:
                    kind, size, flags = struct.unpack_from("<HHB", raw, i)
                    yield from self._message(kind, flags, raw[i + 8 : i + 8 + size], blocks)
                    i += 8 + size
            return
        flags, at = head[5], address + 6 + (16 if head[5] & 32 else 0) + (4 if head[5] & 16 else 0)
        width = 1 << (flags & 3)
        blocks = [(at + width, int.from_bytes(self._at(at, width), "little"))]
        first = True
        while blocks:
            at, n = blocks.pop(0)
            if not first:
                at, n = at + 4, n - 8  # the block's name and checksum
            first = False
            raw, i, extra = self._at(at, n), 0, 2 if flags & 4 else 0
            while i + 4 + extra <= n:
                kind, size, own = struct.unpack_from("<BHB", raw, i)
                yield from self._message(kind, own, raw[i + 4 + extra : i + 4 + extra + size], blocks)
                i += 4 + extra + size

    def _message(self, kind: int, flags: int, body: bytes, blocks: list) -> Iterator[tuple[int, bytes]]:
        if kind == 0x10:
            blocks.append(struct.unpack_from("<QQ", body))
        elif flags & 2 and kind in (0x01, 0x03, 0x0B):
            raise Unsupported("shared messages")
        elif kind:
            yield kind, body

    def _heap(self, address: int) -> bytes:
        if address not in self._heaps:
            size, _, at = struct.unpack_from("<QQQ", self._at(address, 32), 8)
            self._heaps[address] = self._at(at, size)
        return self._heaps[address]

    def _symbols(self, address: int, heap: bytes) -> Iterator[tuple[str, int]]:
        head = self._at(address, 24)
        if head[:4] == b"SNOD":
            n = struct.unpack_from("<H", head, 6)[0]
            raw = self._at(address + 8, 40 * n)
            for i in range(n):
                name, at = struct.unpack_from("<QQ", raw, 40 * i)
                yield heap[name : heap.index(b"\0", name)].decode(), at
            return
        n = struct.unpack_from("<H", head, 6)[0]
        raw = self._at(address + 24, 16 * n + 8)
        for i in range(n):
            yield from self._symbols(struct.unpack_from("<Q", raw, 16 * i + 8)[0], heap)

    def _link(self, b: bytes) -> tuple[str, int] | None:
        flags, i = b[1], 2
        kind = 0
        if flags & 8:
            kind, i = b[i], i + 1
        i += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        width = 1 << (flags & 3)
        n, i = int.from_bytes(b[i : i + width], "little"), i + width
        return (b[i : i + n].decode(), struct.unpack_from("<Q", b, i + n)[0]) if kind == 0 else None

    def _chunks(self, address: int, rank: int) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
        head = self._at(address, 24)
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        width = 8 + 8 * (rank + 1) + 8
        raw = self._at(address + 24, width * n)
        for i in range(n):
            size, mask, *offset = struct.unpack_from(f"<II{rank + 1}Q", raw, width * i)
            child = struct.unpack_from("<Q", raw, width * i + width - 8)[0]
            if level:
                yield from self._chunks(child, rank)
            else:
                yield child, size, mask, tuple(offset[:rank])

    def _filters(self, b: bytes) -> list[tuple[int, list[int]]]:
        version, n, i, out = b[0], b[1], 8 if b[0] == 1 else 2, []
        for _ in range(n):
            which = struct.unpack_from("<H", b, i)[0]
            named = version == 1 or which >= 256
            name = struct.unpack_from("<H", b, i + 2)[0] if named else 0
            i += 4 if named else 2
            count = struct.unpack_from("<H", b, i + 2)[0]
            i += 4 + (name + _pad8(name) if version == 1 else name)
            out.append((which, list(struct.unpack_from(f"<{count}I", b, i))))
            i += 4 * count + (4 if version == 1 and count % 2 else 0)
        return out

    def _attribute(self, b: bytes) -> tuple[str, Any]:
        version = b[0]
        n, t, s = struct.unpack_from("<HHH", b, 2)
        i = 9 if version == 3 else 8
        step = (lambda x: x + _pad8(x)) if version == 1 else (lambda x: x)
        name = b[i : i + n].rstrip(b"\0").decode()
        kind, space = _Type(b[i + step(n) :]), _space(b[i + step(n) + step(t) :])
        data = b[i + step(n) + step(t) + step(s) :]
        if space is None:
            return name, None
        values = self._values(kind, data, int(np.prod(space, dtype=np.int64)))
        return name, values[0] if space == () else values.reshape(space)

    def _values(self, kind: _Type, raw: bytes, n: int) -> np.ndarray:
        a = np.frombuffer(raw, kind.dtype, n)
        if kind.kind == 3:
            return np.array([x.rstrip(b"\0 ").decode("utf-8", "replace") for x in a.tolist()], dtype=object)
        if kind.kind == 8 and kind.is_bool:
            return a.astype(bool)
        if kind.kind == 9:
            got = []
            for x in a.tolist():
                size, at, index = struct.unpack("<IQI", x)
                data = self._object(at, index) if at not in (0, NONE) and size else b""
                got.append(data[:size].decode("utf-8", "replace") if kind.text else np.frombuffer(data, kind.base.dtype, size))
            out = np.empty(n, dtype=object)
            out[:] = got
            return out
        return a

    def _object(self, address: int, index: int) -> bytes:
        if address not in self._collections:
            size = struct.unpack_from("<Q", self._at(address, 16), 8)[0]
            raw, i, held = self._at(address, size), 16, {}
            while i + 16 <= size:
                k, n = struct.unpack_from("<H", raw, i)[0], struct.unpack_from("<Q", raw, i + 8)[0]
                if not k:
                    break
                held[k] = raw[i + 16 : i + 16 + n]
                i += 16 + n + _pad8(n)
            self._collections[address] = held
        return self._collections[address][index]


def tree(node: Node) -> Iterator[tuple[str, str, tuple[int, ...], str]]:
    """All nodes below ``node``: path, ``group`` or ``dataset``, shape and type."""
    for _, child in node.items():
        if child.is_group:
            yield child.name, "group", (), ""
            yield from tree(child)
        else:
            yield child.name, "dataset", child.shape, str(child.dtype)


def plain(value: Any) -> Any:
    """Values as Python's own; arrays of one element as that element, larger ones as lists, bytes as text."""
    if isinstance(value, np.ndarray):
        return plain(value.ravel()[0]) if value.size == 1 and value.ndim <= 1 else [plain(x) for x in value] if value.ndim else plain(value.item())
    if isinstance(value, np.generic):
        value = value.item()
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else value


def nested(node: Node) -> dict[str, Any]:
    """A group as nested dictionaries: datasets and attributes by name; an attribute doesn't hide a dataset."""
    out = {k: plain(v) for k, v in node.attrs.items()}
    for k, child in node.items():
        out[k] = nested(child) if child.is_group else plain(child.read())
    return out


# -- writing ---------------------------------------------------------------------------------------------------------

LEAF, INNER = 32, 16  #: half of the names in a symbol node, and of the nodes in a tree


def _type_of(a: np.ndarray) -> bytes:
    if a.dtype.names:
        return _compound(a)
    if a.dtype == bool:
        base = struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 1, 0, 8)
        return struct.pack("<BBBBI", 0x18, 2, 0, 0, 1) + base + b"FALSE\0\0\0TRUE\0\0\0\0" + b"\0\1"
    if a.dtype.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, 8 if a.dtype.kind == "i" else 0, 0, 0, a.itemsize, 0, 8 * a.itemsize)
    if a.dtype.kind == "f":
        sign, exponent, bits, bias = {2: (15, 10, 5, 15), 4: (31, 23, 8, 127), 8: (63, 52, 11, 1023)}[a.itemsize]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, sign, 0, a.itemsize, 0, 8 * a.itemsize, exponent, bits, 0, exponent, bias)
    if a.dtype.kind == "S":
        return struct.pack("<BBBBI", 0x13, 0x10, 0, 0, max(1, a.itemsize))  # filled with zeros, UTF-8
    raise TypeError(f"values of type {a.dtype} can't be written")


def _compound(a: np.ndarray) -> bytes:
    out = b""
    for name in a.dtype.names:
        kind, offset = a.dtype.fields[name][:2]
        key = name.encode() + b"\0"
        out += key + bytes(_pad8(len(key))) + struct.pack("<IB3xII16x", offset, 0, 0, 0) + _type_of(np.zeros(0, kind))
    return struct.pack("<BHBI", 0x16, len(a.dtype.names), 0, a.itemsize) + out


def _array(value: Any) -> np.ndarray:
    a = np.asarray(value)
    if a.dtype.kind in "UO":
        flat = ["" if x is None else x if isinstance(x, str) else str(x) for x in a.ravel().tolist()]
        coded = [x.encode() for x in flat]
        a = np.array(coded, dtype=f"S{max([1, *map(len, coded)])}").reshape(a.shape)
    return np.ascontiguousarray(a) if a.ndim else a


def _space_of(a: np.ndarray) -> bytes:
    return struct.pack("<BBBB4x", 1, a.ndim, 0, 0) + struct.pack(f"<{a.ndim}Q", *a.shape)


class Writer:
    """Builds a file from nested dictionaries: a dictionary is a group, anything else a dataset.

    A key that starts with ``@`` is an attribute of its group. None is left out.
    """

    def __init__(self) -> None:
        self._out = bytearray(96)

    def _put(self, data: bytes) -> int:
        self._out += bytes(_pad8(len(self._out)))
        at = len(self._out)
        self._out += data
        return at

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(b) + _pad8(len(b)), 0) + b + bytes(_pad8(len(b))) for kind, b in messages)
        return self._put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def _attribute(self, name: str, value: Any) -> tuple[int, bytes]:
        a = _array(value)
        key, kind, space = name.encode() + b"\0", _type_of(a), _space_of(a)
        fill = lambda b: b + bytes(_pad8(len(b)))
        body = struct.pack("<BxHHH", 1, len(key), len(kind), len(space)) + fill(key) + fill(kind) + fill(space) + a.tobytes()
        if len(body) > 65000:
            raise ValueError(f"attribute {name!r} is too large; make it a dataset")
        return 0x0C, body

    def _dataset(self, value: Any) -> int:
        a = _array(value)
        at = self._put(a.tobytes()) if a.nbytes else NONE
        return self._header([(0x01, _space_of(a)), (0x03, _type_of(a)), (0x05, struct.pack("<BBBB", 2, 2, 2, 0)), (0x08, struct.pack("<BBQQ", 3, 1, at, a.nbytes))])

    def _group(self, tree_: dict[str, Any]) -> tuple[int, int, int]:
        """The addresses of the header, the tree and the heap."""
        attrs = [self._attribute(k[1:], v) for k, v in tree_.items() if k.startswith("@") and v is not None]
        children = {k: self._group(v)[0] if isinstance(v, dict) else self._dataset(v) for k, v in tree_.items() if not k.startswith("@") and v is not None}
        heap, offset = bytearray(8), {}
        names = sorted(children, key=str.encode)
        if len(names) > 4 * LEAF * INNER:
            raise ValueError(f"a group of more than {4 * LEAF * INNER} members")
        for k in names:
            offset[k] = len(heap)
            raw = k.encode() + b"\0"
            heap += raw + bytes(_pad8(len(raw)))
        data = self._put(bytes(heap))
        heap_at = self._put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, data))  # 1: nothing is free
        nodes, keys = [], [0]
        for i in range(0, len(names), 2 * LEAF):
            part = names[i : i + 2 * LEAF]
            rows = b"".join(struct.pack("<QQII16x", offset[k], children[k], 0, 0) for k in part)
            nodes.append(self._put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + rows.ljust(80 * LEAF, b"\0")))
            keys.append(offset[part[-1]])
        body = b"".join(struct.pack("<QQ", k, n) for k, n in zip(keys, nodes)) + struct.pack("<Q", keys[-1] if nodes else 0)
        tree_at = self._put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NONE, NONE) + body.ljust(32 * INNER + 8, b"\0"))
        return self._header([(0x11, struct.pack("<QQ", tree_at, heap_at)), *attrs]), tree_at, heap_at

    def build(self, tree_: dict[str, Any]) -> bytes:
        root, tree_at, heap_at = self._group(tree_)
        head = SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, LEAF, INNER, 0) + struct.pack("<QQQQ", 0, NONE, len(self._out), NONE)
        head += struct.pack("<QQII", 0, root, 1, 0) + struct.pack("<QQ", tree_at, heap_at)
        self._out[: len(head)] = head
        return bytes(self._out)


def write(path: str, tree_: dict[str, Any]) -> None:
    """Write nested dictionaries as a file; see ``Writer``."""
    data = Writer().build(tree_)
    with open_output(path) as f:
        f.write(data)
