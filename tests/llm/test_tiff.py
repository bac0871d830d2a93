import hashlib
import struct
import zlib

import numpy as np
import pytest

from codeweave.llm import tiff as T


@pytest.mark.parametrize("scheme", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile, order", [(None, "<"), (16, ">")])
def test_round_trip(scheme, predictor, tile, order):
    rng = np.random.RandomState(0)
    images = [(rng.randint(0, 3, shape) * 60).astype(np.uint8) for shape in ((1, 64, 1), (37, 21, 3), (70, 64, 1))]
    pages = T.read(T.write(images, scheme, predictor, 7, tile, order))
    assert len(pages) == 3 and all((a == b.pixels).all() for a, b in zip(images, pages))


@pytest.mark.parametrize("n", [0, 1, 2, 300, 70_000])
@pytest.mark.parametrize("kinds", [1, 2, 256])
def test_coders(n, kinds):
    data = bytes(np.random.RandomState(n).randint(0, kinds, n).astype(np.uint8))
    assert T.unpack_lzw(T.pack_lzw(data)) == data
    assert T.unpack_bits(T.pack_bits(data)) == data


def test_known_bytes():
    # The example of PackBits, and LZW codes 256 7 258 8 257 packed by hand in nine bits each.
    assert T.unpack_bits(bytes.fromhex("FEAA028000 2AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257)).ljust(48, "0")
    assert T.unpack_lzw(int(bits, 2).to_bytes(6, "big")) == bytes([7, 7, 7, 8])


def test_sixteen_bits_and_planes():
    x = (np.arange(12).reshape(2, 3, 2) * 300).astype(">u2")
    planes = [x[:, :, k].tobytes() for k in range(2)]
    head = b"MM" + struct.pack(">HI", 42, 8 + 24)
    tags = [(256, 4, 3), (257, 4, 2), (258, 3, 16), (259, 3, 1), (277, 3, 2), (278, 4, 2), (284, 3, 2)]
    at = 32 + 2 + 12 * 9 + 4
    body = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">I", v) if k == 4 else struct.pack(">HH", v, 0)) for t, k, v in tags[:4])
    body += struct.pack(">HHII", 273, 4, 2, at) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">I", v) if k == 4 else struct.pack(">HH", v, 0)) for t, k, v in tags[4:6]) + struct.pack(">HHII", 279, 4, 2, at + 8) + struct.pack(">HHIHH", 284, 3, 1, 2, 0)
    data = head + b"".join(planes) + struct.pack(">H", 9) + body + b"\0" * 4 + struct.pack(">IIII", 8, 20, 12, 12)
    (page,) = T.read(data)
    assert (page.pixels == x).all()


def test_pages_of_good_and_bad_files(spark):
    image = np.full((3, 4, 1), 9, np.uint8)
    good = T.write([image, image])
    loop = bytearray(T.write([image]))
    loop[-4:] = struct.pack("<I", struct.unpack_from("<I", loop, 4)[0])
    rows = [(1, good), (2, None), (3, b"junk"), (4, good[:40]), (5, bytes(loop)), (None, good)]
    got = T.pages(spark.createDataFrame(rows, "id long, media binary").selectExpr("*", "id as page")).collect()
    assert sorted((r.id or 0, r.page, r.error is None) for r in got) == [(0, 0, True), (0, 1, True), (1, 0, True), (1, 1, True), (2, 0, False), (3, 0, False), (4, 0, False), (5, 0, True), (5, 1, False)]
    assert T.pages(spark.createDataFrame([], "id long, media binary")).count() == 0


def tagged_file(fields, body=b"", order="<"):
    """One directory of (tag, type, values) right after the header, then the body; offsets in values count from its start as strings."""
    codes = {3: "H", 4: "I", 9: "i", 11: "f"}
    at = 8 + 2 + 12 * len(fields) + 4
    extra = sum(len(struct.pack(f"{order}{len(v)}{codes[k]}", *(0 if isinstance(x, str) else x for x in v))) for _, k, v in fields if struct.calcsize(codes[k]) * len(v) > 4)
    out, more = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, len(fields))), bytearray()
    for tag, kind, values in fields:
        raw = struct.pack(f"{order}{len(values)}{codes[kind]}", *(int(x) + at + extra if isinstance(x, str) else x for x in values))
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(more))
        more += raw if len(raw) > 4 else b""
        out += struct.pack(order + "HHI", tag, kind, len(values)) + value
    return bytes(out + b"\0" * 4 + more + body)


@pytest.mark.parametrize("bits, fill", [(1, 1), (1, 2), (2, 1), (4, 1)])
def test_small_samples(bits, fill):
    rng = np.random.RandomState(bits)
    x = rng.randint(0, 1 << bits, (5, 11, 1)).astype(np.uint8)
    lines = ["".join(f"{v:0{bits}b}" for v in row).ljust(-(-11 * bits // 8) * 8, "0") for row in x[:, :, 0]]
    raw = b"".join(int(line, 2).to_bytes(len(line) // 8, "big") for line in lines)
    body = T.pack_bits(raw)
    if fill == 2:
        body = bytes(int(f"{b:08b}"[::-1], 2) for b in body)
    data = tagged_file([(256, 3, [11]), (257, 3, [5]), (258, 3, [bits]), (259, 3, [T.PACKBITS]), (266, 3, [fill]), (273, 4, ["0"]), (279, 4, [len(body)])], body)
    (page,) = T.read(data)
    assert (page.pixels == x).all()


@pytest.mark.parametrize("predictor", [1, 3])
@pytest.mark.parametrize("order", ["<", ">"])
def test_floats(predictor, order):
    x = np.random.RandomState(3).randn(4, 6, 2).astype(np.float32)
    if predictor == 3:
        rows = []
        for row in x:
            planes = np.frombuffer(row.astype(">f4").tobytes(), np.uint8).reshape(-1, 4).T.reshape(-1, 2).astype(int)
            rows.append(np.diff(planes, axis=0, prepend=np.zeros((1, 2), int)).astype(np.uint8).tobytes())
        raw = b"".join(rows)
    else:
        raw = x.astype(order + "f4").tobytes()
    body = zlib.compress(raw)
    data = tagged_file([(256, 3, [6]), (257, 3, [4]), (258, 3, [32, 32]), (259, 3, [8]), (273, 4, ["0"]), (277, 3, [2]), (279, 4, [len(body)]), (317, 3, [predictor]), (339, 3, [3, 3])], body, order)
    (page,) = T.read(data)
    assert (page.pixels == x).all()


def test_any_malformed_file_gives_an_error_row(spark):
    rng = np.random.RandomState(1)
    image = np.arange(60, dtype=np.uint8).reshape(5, 12, 1)
    files = [tagged_file([(256, 3, [4]), (257, 9, [-3]), (258, 3, [8]), (273, 4, ["0"]), (279, 4, [12])], b"x" * 12), tagged_file([(256, 11, [4.0]), (257, 3, [3]), (258, 3, [8]), (273, 4, ["0"]), (279, 4, [12])], b"x" * 12)]
    bomb = zlib.compress(b"\0" * 50_000_000)
    files.append(tagged_file([(256, 3, [4]), (257, 3, [3]), (258, 3, [8]), (259, 3, [8]), (273, 4, ["0"]), (279, 4, [len(bomb)])], bomb))
    for scheme in (T.NONE, T.LZW, T.DEFLATE, T.PACKBITS):
        good = T.write([image, image], scheme, tile=16)
        for _ in range(150):
            bad = bytearray(good)
            for _ in range(rng.randint(1, 6)):
                bad[rng.randint(len(bad))] = rng.randint(256)
            files.append(bytes(bad))
    for k, f in enumerate(files):
        rows = list(T._rows(k, f))
        assert rows and all((r[-1] is None) == (r[7] is not None) for r in rows), k
    assert [r[-1] is None for k in (0, 1, 2) for r in T._rows(k, files[k])] == [False, False, True]
    got = T.pages(spark.createDataFrame(list(enumerate(files[:40])), "id long, media binary")).collect()
    assert {r.id for r in got} == set(range(40))


def test_feature():
    assert T.feature(b"\0" * 64) == "0.0000,0.0000,1.0000,0.0000"
    assert T.feature(bytes([0, 255] * 32)) == "127.5000,1.0000,0.5000,255.0000" and T.feature(b"") == "0.0000,0.0000,0.0000,0.0000"


def test_stored_texts(spark, docs_of):
    texts = {1: "é" * 5000, 2: None, 3: "", 4: "x" * 64, 5: "x" * 65, 6: "x" * 65}
    got = {r.doc_id: r for r in T.text_features(T.pages(T.stored_texts(docs_of(list(texts.items()))))).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got[5][1:] == got[6][1:]
    both = T.text_features(T.pages(T.stored_texts(docs_of([(None, "a"), (7, "a"), (7, "a")])))).collect()
    assert sorted(str(r.doc_id) for r in both) == ["7", "7", "None"] and len({r[1:] for r in both}) == 1
    assert T.text_features(T.pages(T.stored_texts(docs_of([])))).collect() == []
