"""Turn repair, odd sketches and hard negatives against plain Python over small tables with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, hard_negatives, line_dedup, odd_sketch, turn_repair

# ---------------------------------------------------------------- 11 turn repair

ROLES = ["user", "assistant", "system", "tool", "", "User", None]
SAYS = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Yes.", "ends here. ", "x" * 70_000 + "."]
TURNS = "conv_id long, turn long, role string, text string, n int, conv array<int>, part string"


def conversation(rng, conv, n):
    turns = [rng.choice([k, k, k, k + 1, None]) for k in range(n)]
    return [(conv, t, rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES), rng.choice(SAYS), 1, [2], "p") for t in turns]


def plain_rows(rows):
    """(turn, role, text) in order, nulls as one space."""
    own = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x, *_ in rows]
    return sorted(own, key=lambda o: (o[0] is not None, o[0] or 0, o[1], o[2]))


def expected(rows):
    """Every sequence of edits that is worth a look, tried one by one."""
    seen, faults = set(), []
    for t, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    best = None
    front = {("", "", 0): ()}  # (roles so far, audit, cost) -> lines

    def legal(prefix):
        return re.fullmatch(r"s?(ua)*u?", prefix)

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for (roles, audit, cost), lines in front.items():
            new[roles, audit + "D", cost + 2] = lines
            if fault in ("blank", "duplicate"):
                continue
            for inserts in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
                for r, edit, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    shape = roles + "".join(x[0] for x in inserts) + r[:1]
                    if len(shape) == len(roles) + len(inserts) + 1 and legal(shape):
                        new[shape, audit + "I" * len(inserts) + edit, cost + price + 5 * len(inserts) + 5 * (fault == "truncated")] = (*lines, *(f"{x}:" for x in inserts), f"{r}:{text}")
        least = {}
        for (roles, audit, cost), lines in new.items():  # what is dearer at the same end can't win, nor what is as dear and greater
            end = roles[-1:] if roles else ""
            if end not in least or (cost, audit) < least[end][0]:
                least[end] = (cost, audit), roles, lines
        front = {(roles, audit, cost): lines for (cost, audit), roles, lines in least.values()}
    for (roles, audit, cost), lines in front.items():
        for inserts in ([], ["user", "assistant"], ["assistant"]):
            shape = roles + "".join(x[0] for x in inserts)
            if re.fullmatch(r"(s?(ua)+)?", shape):
                new = (cost + 5 * len(inserts), audit + "I" * len(inserts)), "\n".join((*lines, *(f"{x}:" for x in inserts)))
                best = new if best is None else min(best, new)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    (cost, audit), text = best
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_repair(spark, rows):
    conversations, left = turn_repair.repair(spark.createDataFrame(rows, TURNS).repartition(3))
    got = {r.conv_id: tuple(r[c] for c in SUMMARY) for r in conversations.collect()}
    assert got == {conv: expected(plain_rows(own)) for conv, own in by_conversation(rows).items()}
    lines = {}
    for r in left.orderBy("conv_id", "part", "nth", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, result in got.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == result[-1]


def test_repair(spark):
    rng = random.Random(11)
    rows = [r for conv in range(60) for r in conversation(rng, conv, rng.randrange(1, 9))] + conversation(rng, None, 6)
    check_repair(spark, rows + rows[:9])


def test_repair_of_a_conversation_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "STRETCH", 7)
    rng = random.Random(12)
    rows = [r for conv in range(90) for r in conversation(rng, conv, 4)] + [(500, k, rng.choice(ROLES[:3]), f"{k % 90} {rng.choice('.x')}", 1, [2], "p") for k in range(200)] + conversation(rng, None, 20)
    check_repair(spark, rows)


def test_stretches_join_to_the_whole():
    rng = random.Random(13)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "t", "u", "a", None]), rng.random() < 0.3, rng.choice([1, 1, 3])) for _ in range(rng.randrange(1, 9))]
        rows = [(i, c, 1 if i else t) for i, c, t in rows]
        whole = turn_repair.cheapest(rows, "-")
        cut = rng.randrange(len(rows) + 1)
        joined = {}
        for role, (cost, audit) in turn_repair.cheapest(rows[:cut], "-").items():
            for end, (more, rest) in turn_repair.cheapest(rows[cut:], role).items():
                joined[end] = min((cost + more, audit + rest), joined.get(end, (10**9, "")))
        assert joined == whole


def test_damage(spark):
    rows = [(k // 4, k % 4, "assistant", "One. Two! Three") for k in range(400)] + [(None, None, None, None)]
    got = turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        fault = zlib.crc32(key.encode()) % 20
        assert r.times == {0: 0, 3: 2}.get(fault, 1)
        if fault and r.conv_id is not None:
            assert (r.role, r.text) == ("user" if fault == 4 else "assistant", {1: "", 2: "One Two Three"}.get(fault, "One. Two! Three"))


def test_conversations_without_rows(spark):
    none = turn_repair.repair(spark.createDataFrame([], TURNS))
    assert none[0].count() == none[1].count() == 0
    gone = spark.createDataFrame([(3, 1, "user", "Hi.", 0), (3, 2, "user", "Hi.", 0)], "conv_id long, turn long, role string, text string, times int")
    (r,) = turn_repair.repair(gone)[0].collect()
    assert tuple(r) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---------------------------------------------------------------- 12 odd sketches


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()


def components(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    label = {i: i for i, _ in sets}
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return {i: (len(s), label[i], label[i] == i) for i, s in sets}, len(links)


def near_texts(rng):
    words = [f"w{k}" for k in range(500)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = [None, "", " \t", "one", "ONE", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f", "Ünï ſ x y z q", prose(30_000)]
    texts += [texts[-1] + " tail"]
    for _ in range(25):
        base = prose(rng.randrange(8, 120)).split()
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 8))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
            texts += [texts[-1]] * (rng.random() < 0.2)
    return texts


@pytest.mark.parametrize("cell", [4096, 3])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(odd_sketch, "CELL", cell)
    texts = list(enumerate(near_texts(random.Random(12))))
    rows = [(i, t, "n", 1, [1], "k", "h") for i, t in texts] + [(None, "a b c d e f", "n", 1, [1], "k", "h")]
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n string, key int, comp array<int>, sketch string, rep string").repartition(3)).collect()
    want, links = components(texts)
    assert links > 40
    assert {r.doc_id: tuple(r)[1:] for r in got} == want | {None: (5, None, None)}
    assert len(got) == len(rows)


def test_group_of_near_copies_that_its_leaders_leave_apart(spark):
    """Every document is an edit of one that is not there, so many pairs fall short of the threshold; buckets have several components."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for i in range(120):
        own = list(base)
        for k in rng.sample(range(60), 4):
            own[k] = f"x{i}-{k}"
        texts.append((i, " ".join(own)))
    got = odd_sketch.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == components(texts)[0]


def test_sketches_tell_similarities():
    """Bits of pairs at the threshold lie under the cutoff, those of unlike pairs well above it."""
    rng = np.random.default_rng(3)
    bits = {}
    for share in (0.8, 0.3):
        n, common = 2000, int(round(2000 * 2 * share / (1 + share)))
        own = []
        for _ in range(60):
            h = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            sets = np.sort(h[:n]), np.sort(np.concatenate((h[:common], h[n:])))
            doc = np.repeat([0, 1], [len(s) for s in sets])
            sketch = odd_sketch.odd_sketches(odd_sketch.min_hashes(doc, np.concatenate(sets))[1])
            own.append(int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()))
        bits[share] = own
    assert max(bits[0.8]) <= odd_sketch.MOST < min(bits[0.3])
    assert (1 - 0.8**odd_sketch.ROWS) ** odd_sketch.BANDS < 1e-9


def test_no_documents(spark):
    assert odd_sketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- 13 hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, rank string, score int, part array<int>"


def mined(rows, positives=5, negatives=5):
    own = [(i, lab, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, lab, v in own:
        if i % 100 == 0:
            anchors[i] = min((lab, v), anchors.get(i, (lab, v)))
    for a, (lab, v) in anchors.items():
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in own if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scores if s[2] == lab)[:positives]:
            inside = [s for s in scores if s[2] != lab and 80 * -ps <= 100 * -s[0] <= 100 * -ps]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(sorted(inside)[:negatives], 1)]
    return sorted(out)


def vectors(rng, n=900, d=8):
    centres = rng.normal(0, 1, (12, d))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(0, 0.4, d)).astype(np.float32).tolist(), int(rng.integers(4)), "r", 1, [1]) for i in range(n)]
    same = rows[5][1]
    rows += [(k + 2000, same, k % 3, "r", 1, [1]) for k in range(120)]  # one common vector
    rows += [(3000, None, 1, "r", 1, [1]), (3100, rows[1][1], None, "r", 1, [1]), (None, rows[1][1], 1, "r", 1, [1]), (3200, [float("nan")] * d, 1, "r", 1, [1]), (3300, [None] * d, 2, "r", 1, [1])]
    return rows + [(3400, [0.5, 1.0], 0, "r", 1, [1]), (3401, [0.5, 1.0], 0, "r", 1, [1]), (3402, [0.4, 1.0], 1, "r", 1, [1]), (3500, [], 0, "r", 1, [1]), rows[100], rows[7], (3600, [-x for x in rows[9][1]], 3, "r", 1, [1])]


@pytest.mark.parametrize("per_tree", [8192, 150])
def test_hard_negatives(spark, monkeypatch, per_tree):
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", per_tree)
    rows = vectors(np.random.default_rng(4))
    own = hard_negatives.usable(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = hard_negatives.mine(own, own.filter("vec_id % 100 = 0")).collect()
    assert sorted(tuple(r) for r in got) == mined(rows)


def test_trees_leave_most_rows_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 40, (64, 16))
    x = np.floor(256 * (centres[rng.integers(64, size=8192)] + rng.normal(0, 1, (8192, 16))))
    labels, ids = rng.integers(4, size=8192), np.arange(8192)
    tree = hard_negatives.Ball.grow(ids, labels, x)
    q = x[:64]
    for same in (True, False):
        best = hard_negatives.Best(np.full((64, 1), -np.inf), 5)
        hard_negatives.search(tree, ids[:64], labels[:64], q, same, np.full((64, 1), -(2**63) + 1), np.full((64, 1), 2**63 - 1), best)
        score = (q @ x.T).astype(np.int64)
        score[(labels[:64, None] == labels) != same] = -(2**62)
        score[np.arange(64), np.arange(64)] = -(2**62)
        assert (best.score[:, 0] == -np.sort(-score, axis=1)[:, :5]).all()
        assert best.met < best.pairs / 3
    # a window that few rows meet is searched in few leaves, though no kth score helps
    top = score.max(axis=1)[:, None]
    low = top - np.abs(top) // 20
    best = hard_negatives.Best(np.full((64, 1), -np.inf), 8192)
    hard_negatives.search(tree, ids[:64], labels[:64], q, False, low, top, best)
    assert best.met < best.pairs / 2


def test_large_components(spark):
    rows = [(i, [1e18 * (1 + i % 3), -3.5], i % 2) for i in range(40)] + [(100, [1e18, 1.0], 0)]
    own = hard_negatives.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = hard_negatives.mine(own, own.filter("vec_id % 100 = 0"))
    assert got.filter("positive_score <> 9223372036854775807").count() == 0 and got.count() > 0


def test_no_vectors(spark):
    own = hard_negatives.usable(spark.createDataFrame([], VECTORS))
    assert hard_negatives.mine(own, own).count() == 0


def test_queries_read_whole_tables(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = vectors(rng, 300)
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = hard_negatives.op13_hard_negatives(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    moved = [(i, v, None if lab is None else (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab, *_ in rows]
    assert sorted(tuple(r) for r in got.collect()) == mined(moved)
    turns = conversation(random.Random(3), 1, 9) + conversation(random.Random(4), 2, 9)
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = turn_repair.op11_turn_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", *SUMMARY] and {t for c, t in got.dtypes if c not in ("audit", "repaired_sha256")} == {"bigint"}
    damaged = {1: [], 2: []}
    for r in turn_repair.damaged(spark.createDataFrame(turns, TURNS)).collect():
        damaged[r.conv_id] += [(r.conv_id, r.turn, r.role, r.text)] * r.times
    want = {k: expected(plain_rows(v)) for k, v in damaged.items()}
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
    assert got.filter(F.col("conv_id").isNull()).count() == 0


# ---------------------------------------------------------------- repeats and names that clash in operators 8 and 10


def test_benchmark_words_that_repeat():
    """Every place of a repeated window is hit, the longest run is found, and equal windows cost no pairs."""
    tests = decontaminate.TestSuffixes([("a", b"w " * 2000), ("b", b"w " * 20 + b"x"), ("c", b"y z"), ("d", b"w " * 12)])
    got = decontaminate.scan([b"w " * 20_000, b"v " + b"w " * 20 + b"x w", b"y z y z", b"q", None], tests)
    assert got[0] == [20_000, [0], [20_000], ["a", "b", "d"], 2000, "a", 0]
    assert got[1] == [23, [1], [22], ["a", "b", "d"], 21, "b", 1]  # the last w alone is no window
    assert got[2] == [4, [0], [4], ["c"], 2, "c", 0]
    assert got[3][:4] == [1, [], [], []] and got[4][:4] == [0, [], [], []]


def test_ranges_and_longest_matches_by_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        words = lambda n: [rng.choice("ab") for _ in range(n)]
        items, docs = [words(rng.randrange(1, 9)) for _ in range(4)], [words(rng.randrange(0, 30)) for _ in range(3)]
        tests = decontaminate.TestSuffixes([(str(k), " ".join(x).encode()) for k, x in enumerate(items)], window=4)
        for doc, row in zip(docs, decontaminate.scan([" ".join(x).encode() for x in docs], tests), strict=True):
            hit, found, longest = set(), set(), (0, 0, 0)
            for k, item in enumerate(items):
                for a in range(max(1, len(item) - 3)):
                    size = min(4, len(item))
                    for p in range(len(doc) - size + 1):
                        if doc[p : p + size] == item[a : a + size]:
                            hit |= set(range(p, p + size))
                            found.add(str(k))
                            while p + size < len(doc) and a + size < len(item) and doc[p + size] == item[a + size]:
                                size += 1
                            longest = min(longest, (-size, p, k))
                            size = min(4, len(item))
            assert {x for a, b in zip(row[1], row[2], strict=True) for x in range(a, b)} == hit and row[3] == sorted(found)
            assert not found or (row[4], row[6], row[5]) == (-longest[0], longest[1], str(longest[2]))


def test_columns_of_any_name(spark, monkeypatch):
    rows = [(1, "a\nb\nc\nd", "mine", "gone", 7, 8), (2, "a\nb\nc\nd", "yours", None, 7, 9), (3, None, "x", "y", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dl_text string, dl_gone string, dl_left int, dc_row long")
    for every in (False, True):
        got = line_dedup.dedup_lines(docs, every=every)
        assert {tuple(r[c] for c in ("doc_id", "dl_text", "dl_gone", "dl_left", "dc_row")) for r in got.collect()} == {(r[0], *r[2:]) for r in rows}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8)
    items = spark.createDataFrame([(1, "q r s"), (2, "a b c"), (3, "t u v")], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.remove_contaminated(docs, items).collect()} == {rows[2]}
