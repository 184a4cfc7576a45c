import random
import struct
import zlib

import numpy as np
import pytest
import xxhash

from lectern.llm import line_dedup, media, packing, simhash, token_file
from lectern.llm.hashing import PerfectHash
from lectern.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, n_dropped string, fp string"
LONG = "\n".join(f"a line that repeats often {i % 700} and is long" for i in range(6000))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = "the of and licence text über Straße naïve 漢字 data's 12,345 x".split()
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))).replace(" x", "\n")) for i in range(60)]
    out += [(60, None), (61, ""), (62, "\n\n"), (63, LONG), (64, LONG + "\nend"), (65, LONG), (None, LONG), (66, "one"), (67, "ONE"), (68, "one  two\t\n three"), (69, "  lead and trail \n"), (69, "  lead and trail \n"), (70, "é" * 25), (71, "É" * 25), (72, "  " + "é" * 25), (73, "<|endoftext|> a\x1cb c d \xa0 e"), (74, "a\n\n  b   \n c!?\x1c!  ")]
    out += [(75, "<|endoftext|> x"), (76, "say<|startoftext|><|ENDOFTEXT|> it"), (77, LONG[:3000] + " <|endoftext|>\n" + LONG[:500]), (78, "<|endoftext|>")]
    held = "Held by two documents, one of them twice"  # so it stays
    out += [(80, held), (80, held), (81, held), (82, "In three documents, twice in the last"), (83, "In three documents, twice in the last"), (84, "In three documents, twice in the last"), (84, "in three documents, twice in the last \nx")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted(rows, key=repr)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert sorted(PerfectHash.build(keys).index(keys)) == list(range(len(keys)))
    assert len(PerfectHash.build(keys[:0]).index(keys)) == len(keys)
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 9, 5], np.uint64))


def test_keys_that_mix_to_the_same_value_are_told_apart():
    import pandas as pd

    from lectern.llm.hashing import mix

    h2 = np.array([3, 4, 5], np.uint64)
    h1 = mix(h2, 0) ^ np.uint64(7)  # under the first seed all three are 7
    row = line_dedup._build(pd.DataFrame({"shard": 0, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "n": [3, 4, 5], "keep": [30, 40, 50]})).iloc[0]
    n, keep = line_dedup.LineIndex(1, [row]).probe(np.append(h1, h1[:1]), np.append(h2, h2[1:2]))
    assert n.tolist() == [3, 4, 5, 0] and keep.tolist()[:3] == [30, 40, 50]


@pytest.mark.parametrize("round_bytes", [64 << 20, 1])
def test_line_dedup(docs, rows, round_bytes, monkeypatch):
    assert {(w[0], w[2]) for w in line_dedup.brute_force(rows) if w[0] in (80, 81, 82, 83, 84)} == {(80, 0), (81, 0), (82, 1), (83, 1), (84, 0)}
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 200 if round_bytes == 1 else 1 << 16)
    out = line_dedup.dedup_lines(docs, round_bytes=round_bytes)
    assert out.columns == ["doc_id", "text", "lang", "fp", "n_lines", "n_dropped"]
    got = out.select("doc_id", "n_lines", "n_dropped", line_dedup.sha256_hex("text")).collect()
    assert key(map(tuple, got)) == key(line_dedup.brute_force(rows))


def test_empty_tables(spark, empty, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert packing.pack(empty, path).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert media.decode_media(media.text_media(empty)).count() == 0
    folder = token_file.write_token_files(empty, path)
    assert token_file.read_token_files(spark, folder).count() == 0


def expected_ids(rows, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x in rows]


def test_packing(docs, rows):
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    want = expected_ids(rows, "word_bpe_49k.json", 1)
    assert sum(len(p.ids) // 4 for p in pieces) == sum(len(x) for _, x in want)
    whole: dict = {}
    for p in pieces:
        whole.setdefault((p.doc_id, p.sequence_id * 2048 + p.offset - p.start, p.doc_tokens), []).append((p.start, p.ids))
    got = [(k[0], list(struct.unpack(f"<{k[2]}I", b"".join(b for _, b in sorted(v))))) for k, v in whole.items()]
    assert key(got) == key(want)
    by: dict = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, len(p.ids) // 4))
    for k, v in by.items():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at == 2048 or k == max(by)
    assert packing.sequences(packing.pack(docs, tokenizer_path("word_bpe_49k.json"))).count() == len(by)


@pytest.mark.parametrize("file_ids", [1 << 22, 5000])
def test_token_files(spark, docs, rows, file_ids):
    folder = token_file.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), file_ids=file_ids)
    got = token_file.read_token_files(spark, folder).collect()
    want = expected_ids(rows, "byte_bpe_50k.json", 2)
    assert key((r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", r.ids))) for r in got) == key(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_coder_detects_damage():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.2, 40_000), 50_000).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    coder = token_file.Coder(symbols, token_file.frequency_table(symbols, counts))
    raw = token_file.write_file([1, None], np.array([39_000, 1000]), ids, 5, coder)
    f = token_file.TokenFile(raw)
    assert (f.tokens() == ids).all() and (f.tokens(20_000, 20_010) == ids[20_000:20_010]).all() and f.first == 5 and f.doc_ids == [1, None]
    with pytest.raises(ValueError):
        token_file.TokenFile(raw[:-5] + bytes([raw[-5] ^ 1]) + raw[-4:]).tokens()
    one = token_file.Coder(np.array([9]), token_file.frequency_table(np.array([9]), np.array([4])))
    assert (token_file.TokenFile(token_file.write_file([1], np.array([4]), np.full(4, 9, np.uint32), 0, one)).tokens() == 9).all()


def brute_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("group", [48, 2])
def test_simhash(spark, docs, rows, group):
    rng = random.Random(5)
    more = []
    for i in range(100, 200):  # near copies of one text
        words = LONG.split()[:300]
        words[rng.randrange(300)] = "other"
        more.append((i, " ".join(words)))
    extra = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in more], SCHEMA)
    got = simhash.near_duplicates(docs.unionByName(extra), group=group).collect()
    every = [*rows, *more]
    fps = [brute_fingerprint(t) for _, t in every]
    roots = brute_components(fps)
    least: dict = {}
    for (i, _), r in zip(every, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert key((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == key((i, f, least.get(r)) for (i, _), f, r in zip(every, fps, roots))


@pytest.mark.parametrize("group,distance", [(48, 2), (1, 2), (1, 1)])
def test_close_pairs_connect_as_all_pairs(spark, group, distance):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:8]:
        for _ in range(12):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), distance=distance, group=group).collect()
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= distance for a, b in links)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a % 2**64)] = find(b % 2**64)
    got: dict = {}
    for x in fps:
        got.setdefault(find(x), set()).add(x)
    root = {x: x for x in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    want: dict = {}
    for x in fps:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_media(docs, rows):
    got = media.decode_media(media.text_media(docs)).collect()
    assert len(got) == len(rows)
    want = key((i, (t or "").encode() + bytes(-len((t or "").encode()) % 64 if t else 64)) for i, t in rows)
    assert key((r.doc_id, r.pixels) for r in got) == want
    assert all(r.error is None and r.width == 64 and len(r.dhash) == 16 and np.load(__import__("io").BytesIO(r.tile)).shape == (32, 32, 1) for r in got)


def brute_dhash(pixels, size=8):
    """Means of a picture's cells, part of a pixel counting by its area, one by one; then neighbours compared."""
    h, w = pixels.shape
    cells = [[0.0] * (size + 1) for _ in range(size)]
    for i in range(size):
        for j in range(size + 1):
            top, bottom, left, right = i * h / size, (i + 1) * h / size, j * w / (size + 1), (j + 1) * w / (size + 1)
            total = 0.0
            for y in range(int(top), min(h, int(np.ceil(bottom)))):
                for x in range(int(left), min(w, int(np.ceil(right)))):
                    total += float(pixels[y, x]) * (min(bottom, y + 1) - max(top, y)) * (min(right, x + 1) - max(left, x))
            cells[i][j] = total / ((bottom - top) * (right - left))
    bits = "".join("1" if cells[i][j] < cells[i][j + 1] - 1e-9 else "0" for i in range(size) for j in range(size))
    return f"{int(bits, 2):016x}"


def test_media_feature_against_brute_force(docs, rows):
    got = {}
    for r in media.decode_media(media.text_media(docs)).select("doc_id", "pixels", "dhash").collect():
        got.setdefault(r.doc_id, set()).add((len(r.pixels), r.dhash))
    for i, t in rows:
        raw = (t or "").encode()
        if len(raw) < 20_000:
            pixels = np.frombuffer(raw + bytes(-len(raw) % 64 if raw else 64), np.uint8).reshape(-1, 64)
            assert (pixels.size, brute_dhash(pixels)) in got[i], i


def test_resize_in_bands(monkeypatch):
    image = np.random.default_rng(5).integers(0, 256, (500, 64, 3)).astype(np.uint8)
    whole = media.resize_area(image, 32, 32)
    monkeypatch.setattr(media, "BAND", 3)
    assert np.allclose(media.resize_area(image, 32, 32), whole)
    assert np.allclose(whole.mean((0, 1)), image.mean((0, 1)))


def test_media_formats(spark):
    rng = np.random.default_rng(2)
    grey = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    colour = rng.integers(0, 256, (4, 3, 3)).astype(np.uint8)
    assert (media.read_image(media.write_bmp(grey))[:, :, 0] == grey).all()
    assert (media.read_image(b"P6 # c\n3 4\n# d\n255\n" + colour.tobytes()) == colour).all()
    assert (media.read_image(b"P3\n3 4\n255\n" + b" ".join(b"%d" % x for x in colour.ravel())) == colour).all()
    assert (media.read_image(b"P2\n7 5\n255\n" + b" ".join(b"%d" % x for x in grey.ravel()))[:, :, 0] == grey).all()
    bits = grey > 127
    assert (media.read_image(b"P4\n7 5\n" + np.packbits(~bits, axis=1).tobytes())[:, :, 0] == bits * 255).all()
    assert (media.read_image(b"P1\n7 5\n" + b"".join(b"%d" % (not x) for x in bits.ravel()))[:, :, 0] == bits * 255).all()
    deep = rng.integers(0, 65536, (2, 3)).astype(">u2")
    assert (media.read_image(b"P5 3 2 65535\n" + deep.tobytes())[:, :, 0] == deep).all()
    head = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, -4, 1, 24, 0, 0, 0, 0, 0, 0)
    assert (media.read_image(head + np.pad(colour[:, :, ::-1].reshape(4, 9), ((0, 0), (0, 3))).tobytes()) == colour).all()
    assert np.allclose(media.resize_area(grey[:, :, None].astype(float), 5, 7)[:, :, 0], grey)
    assert np.allclose(media.resize_area(grey[:, :, None], 1, 1)[0, 0, 0], grey.mean())
    bad = media.decode_media(spark.createDataFrame([(1, b"P9 no"), (2, None), (3, b"BM")], "id long, media binary")).collect()
    assert all(r.error and r.pixels is None for r in bad)


def test_crc_is_of_unsigned_ids(docs):
    from pyspark.sql import functions as F

    r = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).select("ids", F.crc32("ids").alias("c")).first()
    assert r.c == zlib.crc32(r.ids)


def test_slices_of_batches(rows):
    import pyarrow as pa

    from lectern.llm import tokens

    texts = pa.array([t for _, t in rows] * 3)
    for name, cut, end in (("word_bpe_49k.json", "words", 1), ("byte_bpe_50k.json", "spaces", 2)):
        got = [list(x) for x in tokens.Encoder(tokenizer_path(name), cut, limit=50, slice_bytes=1000).encode(texts)]
        assert got == [ids[:-1] for _, ids in expected_ids(rows, name, end)] * 3
    fps = [simhash._fingerprints(pa.concat_arrays([texts.slice(k, 7)]), 3).tolist() for k in range(0, len(texts), 7)]
    assert sum(fps, []) == [brute_fingerprint(t) for _, t in rows] * 3
