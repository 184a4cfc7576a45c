import numpy as np
import pyarrow as pa

from lectern.llm import near_copies as N


def test_fingerprints_are_majority_bits(spark):
    texts = ["a b c d e", "one two three four five six seven eight", " ".join(f"w{k}" for k in range(700)), "few words", "", None]
    rows = {r.id: r for r in N.signatures(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", 5).collect()}
    n, h = N._sets(pa.array(texts), 5)
    mask = (1 << 64) - 1
    for i, (size, end) in enumerate(zip(n.tolist(), np.cumsum(n).tolist())):
        ones = [0] * (64 * len(N.ODD))
        for x in h[end - size : end].view(np.uint64).tolist():
            for word, odd in enumerate(N.ODD.tolist()):
                y = x * odd & mask
                y = (y ^ (y >> 32)) * 0xD6E8FEB86659FD93 & mask
                y ^= y >> 29
                for bit in range(64):
                    ones[64 * word + bit] += y >> bit & 1
        flags = [2 * k > size for k in ones]
        assert np.packbits(flags[: N.CHECK]).tobytes() == np.array([rows[i].c0, rows[i].c1]).tobytes()
        bits = flags[N.CHECK :]
        want = [(j << N.BITS) + sum(f << k for k, f in enumerate(bits[j * N.BITS : (j + 1) * N.BITS])) for j in range(N.BLOCKS)]
        more = [(N.BLOCKS + j << N.BITS) + sum(f << k for k, f in enumerate(bits[j : N.BITS * N.BLOCKS : N.BLOCKS])) for j in range(N.BLOCKS)]
        assert rows[i].n == size and list(rows[i].blocks) == ([] if not size else want + more if size <= N.SMALL else want)


def test_rows_of_a_block_group_by_distance():
    rng = np.random.default_rng(3)
    key, check = [], []
    for k, m in enumerate([1, 2, 5, 31, 32, 33, 90, 400, 3, 1, 60, 2]):
        bits = rng.integers(0, 2, (m, N.CHECK), dtype=np.uint8)
        for i in range(1, m):  # chains, stars and strangers
            if rng.random() < 0.7:
                bits[i] = bits[rng.integers(0, i)]
                bits[i, rng.choice(N.CHECK, N.DISTANCE + int(rng.integers(-3, 3)), replace=False)] ^= 1
        order = rng.permutation(m)
        key += [k] * m
        check.append(np.packbits(bits, axis=1).view(np.int64)[order])
    key, check = np.array(key, np.int32), np.concatenate(check)
    sig = np.arange(len(key)) * 7919 - 10**6
    root = np.arange(len(key))
    for i in range(len(key)):
        for j in range(i):
            if key[i] == key[j] and np.bitwise_count((check[i] ^ check[j]).view(np.uint64)).sum() <= N.DISTANCE:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    want = sorted(sorted(sig[root == r].tolist()) for r in set(root.tolist()) if (root == r).sum() > 1)
    table = pa.table({"key": key, "sig": sig, "n": sig.astype(np.int32), "c0": check[:, 0], "c1": check[:, 1]})
    for rows in (1, 7, 50, 10000):
        found = {}
        for b in N._near(iter(table.to_batches(max_chunksize=rows))):
            for name, s, size in zip(*(b.column(c).to_pylist() for c in ("key", "sig", "n"))):
                assert s == size
                found.setdefault(name, []).append(s)
        assert sorted(map(sorted, found.values())) == want
    assert len(want) > 10 and max(map(len, want)) > N.RUN and list(N._near(iter([]))) == []


def test_pairs_at_the_bound_share_a_block():
    """Sets with a Jaccard of 0.8 exactly, as hashes: large, small and the smallest ones."""
    rng = np.random.default_rng(4)
    for one, two, both in ((45, 45, 40), (100, 80, 80), (9, 9, 8), (5, 4, 4)):
        k = 1000
        hashes = rng.integers(-(2**63), 2**63 - 1, (k, one + two - both), dtype=np.int64)
        (x, cx), (y, cy) = (N._split(N._majority(np.ascontiguousarray(h).ravel(), np.full(k, h.shape[1]))) for h in (hashes[:, :one], np.delete(hashes, np.s_[both:one], axis=1)))
        blocks = N.BLOCKS * (2 if max(one, two) <= N.SMALL else 1)
        met = (x == y)[:, :blocks].any(1) & (np.bitwise_count((cx ^ cy).view(np.uint64)).sum(1) <= N.DISTANCE)
        assert met.mean() >= 0.997
