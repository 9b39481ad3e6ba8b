"""Conversation repair, SimHash links and centroid clusters against plain versions; the queries' contracts."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routescope.llm import repair, shallot, simhash
from routescope.llm.tables import components

pytest.importorskip("public_tokenizers")

from routescope.llm.queries import QUERIES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Repair ------------------------------------------------------------------------------------


def cheapest_edits(symbols):
    """All audits with at most two insertions at a place, tried one by one."""
    best = None
    choices = [("D",) if s == "d" else ("K", "R", "D") for s in symbols]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(range(3), repeat=len(symbols) + 1):
            audit, pattern, cost = "", "", 0
            for i, n in enumerate(gaps):
                audit, pattern, cost = audit + "I" * n, pattern + "?" * n, cost + 3 * n
                if i < len(symbols):
                    s, e = symbols[i], edits[i]
                    audit += e
                    cost += {"K": 0, "R": 3, "D": 4}[e] + (3 if s.isupper() and e != "D" else 0)
                    pattern += {"K": s.lower(), "R": "?", "D": ""}[e]
            want = ("s" if len(pattern) % 2 else "") + "ua" * (len(pattern) // 2)
            sound = len(pattern) != 1 and all(w == p or p == "?" and w != "s" for w, p in zip(want, pattern))
            if sound and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_chart_against_every_edit():
    for n in range(1, 4):
        for symbols in map("".join, itertools.product("dsuaxUA", repeat=n)):
            assert repair.cheapest(repair.chart(symbols)) == cheapest_edits(symbols), symbols


def test_spans_of_any_cut_agree():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 40, 133):
        symbols = "".join(rng.choice(list("dsuaxSUAX"), n))
        parse = repair.Parse()
        for s in symbols:
            parse.feed(s)
        whole, step = repair.INSERTIONS, repair.INSERTIONS
        for s in symbols:
            step = repair.joined(step, repair.chart(s))
        assert parse.cell() == step
        for cut in (0, n // 3, n):
            left, right = repair.Parse(), repair.Parse()
            for s in symbols[:cut]:
                left.feed(s)
            for s in symbols[cut:]:
                right.feed(s)
            whole = repair.joined(left.cell(), right.cell())
            assert whole == step


def plain_repair(rows):
    """The contract said once more, row by row: conv_id -> result."""
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, left in kept.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, counts, symbols = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), ""
        for _, role, text in left:
            solid = "".join(WORD.findall(text))
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = role[0] if role[:1] in ("s", "u", "a") and role else "x"
            symbols += "d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        turns = {t for t, _, _ in left if t is not None}
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        # least (cost, audit) per state, row by row
        cell = dict(repair.INSERTIONS)
        for s in symbols:
            cell = repair.joined(cell, repair.chart(s))
        cost, audit = repair.cheapest(cell)
        size, at, lines = len(audit.replace("D", "")), 0, []
        todo = iter(left)
        for e in audit:
            row = next(todo) if e != "I" else None
            if e == "D":
                continue
            given = "user" if (size - at) % 2 == 0 else "assistant"
            lines.append(f"{row[1] if e == 'K' else given}:{'' if e == 'I' else row[2]}")
            at += 1
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, audit string, cost bigint"


def some_conversations():
    rng = np.random.default_rng(3)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "open", " \t", "", None, "Why? \x0b", "é.", "a "]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.integers(1, 12)):
            if rng.random() < 0.9:
                rows.append((conv, None if rng.random() < 0.05 else int(turn), str(r) if (r := rng.choice(roles)) is not None else None, t if (t := texts[rng.integers(len(texts))]) is None else str(t)))
    rows += rows[5:9]  # repeated rows
    rows += [(900, t, "user" if t % 2 else "assistant", "long " * 3000 + str(t % 7)) for t in range(400)]
    rows += [(901, 4, "user", "one turn.")] * 40
    return rows


@pytest.fixture
def conversation_rows(spark):
    rows = some_conversations()
    return rows, spark.createDataFrame([(*r, "clash", 7) for r in rows], CONVERSATIONS)


def test_repair_against_a_plain_rewrite(spark, tmp_path, conversation_rows):
    rows, frame = conversation_rows
    frame.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op11_repair"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r["conv_id"]: tuple(r)[1:] for r in got.collect()}
    assert found == plain_repair(rows)


def test_a_conversation_over_many_tasks_parses_as_in_one(spark):
    rows = [(7, t, r, x) for t, (r, x) in enumerate(zip(["user", "user", "assistant"] * 200, ["a.", "b", "c!", "", "d?"] * 120))]
    rows = [(c, t, r, x + (f" {t}." if x else "")) for c, t, r, x in rows]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    marked = repair.faults(repair.numbered(frame))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = repair.fragments(marked)
        assert pieces.count() > 1
        got = repair.parsed(pieces).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    cell = dict(repair.INSERTIONS)
    for _, _, role, text in rows:
        cell = repair.joined(cell, repair.chart(role[0] if text else "d"))
    assert (got["cost"], got["audit"]) == repair.cheapest(cell)
    written = repair.repaired(marked, repair.parsed(repair.fragments(marked)).select("conv_id", "audit")).orderBy("piece").collect()
    assert "".join(r["role"][0] for r in written) == "ua" * (len(written) // 2)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], CONVERSATIONS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["op11_repair"](spark, str(tmp_path)).collect() == []


# SimHash -----------------------------------------------------------------------------------


def plain_print(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    features = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(f.encode(), 42) for f in features]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_parts(prints, radius=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius and find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, print bigint"


def some_documents():
    rng = np.random.default_rng(4)
    prose = [" ".join(rng.choice([f"w{i}" for i in range(300)], 200)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(prose)]
    for k in range(60):  # near copies of two texts
        words = prose[k % 2].split()
        words[int(rng.integers(200))] = f"new{k}"
        rows.append((100 + k, " ".join(words)))
    rows += [(1, prose[5].upper()), (300, prose[7]), (300, prose[7]), (7000, None), (7001, ""), (7002, " \t\n\x0b\x0c\r "), (7003, "Ä b C"), (7004, "ä b c")]
    rows += [(7005, "one"), (7006, "ONE "), (None, prose[3]), (None, "nameless"), (7007, "x " * 150_000), (7008, "X\n" * 90_000)]
    return rows


def test_simhash_against_all_pairs(spark, tmp_path):
    rows = some_documents()
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "clash", 5) for i, t in rows], DOCS)
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_simhash"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [plain_print(t) for _, t in rows]
    part = plain_parts(prints)
    least = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    want = sorted((str(i), f"{x:016x}", str(least.get(p))) for (i, _), x, p in zip(rows, prints, part))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want
    assert len(set(part)) < len(set(prints)) < len(rows)


def test_every_close_pair_shares_a_block():
    masks = simhash.blocks()
    assert len(masks) == 15
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("cell", [4, 32, 2048])
def test_parts_of_large_blocks(spark, cell):
    """Rings of fingerprints close to their neighbours only, within blocks far larger than a cell."""
    rng = np.random.default_rng(cell)
    prints = set()
    for _ in range(6):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            for b in rng.choice(40, rng.integers(1, 6), replace=False):  # the upper pieces stay
                x ^= 1 << int(b)
            prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "print bigint")
    got = {r["print"]: r["root"] for r in simhash.parts(frame, cell).collect()}
    want = plain_parts(prints)
    by_root, by_want = {}, {}
    for p, w in zip(prints, want):
        by_root.setdefault(got.get(p, p), set()).add(p)
        by_want.setdefault(w, set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))
    assert any(len(s) > 1 for s in by_want.values())


@pytest.mark.parametrize("cell", [7, 40, 1000])
def test_components_over_any_number_of_tasks(spark, cell):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    prints = sorted({x for pair in links for x in pair})
    least = {x: x for x in prints}
    for _ in prints:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    for kind in ("bigint", "binary"):
        frame = spark.createDataFrame(links, "a bigint, b bigint")
        if kind == "binary":  # in the order of the numbers
            frame = frame.select(*[F.unhex(F.lpad(F.hex(c), 16, "0")).alias(c) for c in "ab"])
        got = {r["node"]: r["root"] for r in components(frame, cell=cell).collect()}
        want = {a: b for a, b in least.items() if any(a in pair and pair[0] != pair[1] for pair in links)}
        assert got == (want if kind == "bigint" else {a.to_bytes(8, "big"): b.to_bytes(8, "big") for a, b in want.items()})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op12_simhash"](spark, str(tmp_path)).collect() == []


# Clusters ----------------------------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**21 for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    points = np.array([v for _, v in kept], object)

    def assign():
        d = np.array([((points - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], object).T
        return [min(range(len(centroids)), key=lambda j: (row[j], j)) for row in d], d

    for _ in range(rounds):
        near, _ = assign()
        for j in range(len(centroids)):
            own = [points[i] for i, c in enumerate(near) if c == j]
            if own:
                centroids[j] = [int(sum(x)) // len(own) for x in zip(*own)]
    near, d = assign()
    own = {j: sum(int(d[i][j]) for i, c in enumerate(near) if c == j) for j in set(near)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, int(d[n][c]), own[c], sum(own.values()), digest[c]) for n, ((i, _), c) in enumerate(zip(kept, near)))


EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, cluster int, distance bigint"


def embedding_table(spark, place, rows):
    spark.createDataFrame([(i, v, 0, 99, 99) for i, v in rows], EMBEDDINGS).repartition(3).write.parquet(str(place / "embeddings.parquet"))
    return str(place)


def vectors(kind, n=300):
    rng = np.random.default_rng(8)
    if kind == "blobs":
        centres = rng.normal(size=(9, 64)) * 3
        return [(i, (centres[rng.integers(9)] + rng.normal(size=64) * 0.05).astype(np.float32).tolist()) for i in range(n)]
    if kind == "ties":  # few places, many equal distances and repeated vectors
        return [(i, rng.choice([-0.05, 0.0, 0.05], 64 if i % 3 else 64).astype(np.float32).tolist() if i % 2 else [0.0] * 63 + [float(i % 5) / 8]) for i in range(n)]
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [float("nan")] + [0.0] * 63), (1005, [float("inf")] + [0.0] * 63), (1006, [None] + [0.1] * 63)]
    rows += [(1007, [0.0] * 64), (1008, [3e30] + [0.0] * 63), (1009, [2e6] * 64), (1009, [2e6] * 64), (None, [-0.01] * 64)]
    return rows


@pytest.mark.parametrize("kind", ["blobs", "ties", "odd"])
def test_clusters_against_plain_rounds(spark, tmp_path, kind):
    rows = vectors(kind)
    got = QUERIES["op13_shallot"](spark, embedding_table(spark, tmp_path, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_fewer_vectors_than_centroids(spark, tmp_path, n):
    rows = vectors("blobs")[:n]
    got = QUERIES["op13_shallot"](spark, embedding_table(spark, tmp_path, rows)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == (plain_clusters(rows) if rows else [])


def test_bounds_spare_measurements():
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (16, 64))
    v = centres[rng.integers(16, size=2000)] + rng.integers(-3, 4, (2000, 64))
    search = shallot.Search(centres, np.zeros(16))
    near, other, upper, lower, searched = search.assign(v, np.zeros(2000, np.int64), np.ones(2000, np.int64), np.full(2000, np.inf), np.zeros(2000))
    assert len(searched) == 2000
    exact = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (near == exact.argmin(axis=1)).all() and np.allclose(lower**2, np.sort(exact, axis=1)[:, 1])
    again = shallot.Search(centres + 1, np.full(16, 8.0))
    moved, _, _, _, searched = again.assign(v, near, other, upper, lower)
    assert len(searched) < 100 and (moved == ((v[:, None, :] - centres[None] - 1) ** 2).sum(axis=2).argmin(axis=1)).all()
