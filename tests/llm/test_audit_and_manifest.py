"""Near groups by sketches, the filter audit and the Merkle manifest against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialtrace.llm import filter_audit, hyper_minhash, merkle
from tests.llm.test_operators import WORDS, collected, documents, odd_rows, words  # noqa: F401


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------ near groups


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(ws) < 4:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)}


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            ids[g].append(i)
    out = Counter()
    for g, s, (i, _) in zip(group, sets, rows, strict=True):
        least = (min(ids[g]) if ids[g] else None) if s else i
        out[i, len(s), least, i == least] += 1
    return out


def test_near_groups(spark, odd_rows):  # noqa: F811
    rng = random.Random(8)
    base = [f"v{rng.randrange(500)}" for _ in range(90)]
    chain = []
    for k in range(30):  # each is near its neighbours and far from most others
        base = [w if rng.random() > 0.02 else f"u{rng.randrange(500)}" for w in base]
        chain.append((600 + k, " ".join(base)))
    small = [(700 + k, " ".join(f"s{j}" for j in range(k % 4, 5 + k % 7))) for k in range(40)]
    rows = odd_rows + chain + small + [(None, "of no id at all here"), (800, "ONE"), (801, "one"), (802, chain[0][1].upper())]
    found = hyper_minhash.near_groups(documents(spark, rows))
    assert collected(found, "doc_id", "n_shingles", "component_id", "kept") == plain_groups(rows)


def test_large_group_takes_pairs_in_proportion(spark):
    """Of a group of near copies that are all alike, each is compared a few times, not with all others."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(150)]
    rows = [(k, " ".join(w if rng.random() > 0.002 else f"x{k}" for w in passage) + f" end{k}") for k in range(300)]
    seen = []
    plain = hyper_minhash.links_of

    def counted(pairs, texts):
        seen.append(pairs.count())
        return plain(pairs, texts)

    hyper_minhash.links_of = counted
    try:
        found = hyper_minhash.near_groups(documents(spark, rows))
    finally:
        hyper_minhash.links_of = plain
    assert collected(found, "doc_id", "component_id") == Counter((k, 0) for k in range(300))
    assert sum(seen) <= 2 * 300


def test_group_that_falls_short_makes_few_pairs(spark, monkeypatch):
    """Texts that are all a little less alike than links need are told apart in the join, not pair by pair."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(400)]
    rows = [(k, " ".join(w if rng.random() > 0.023 else f"x{k}" for w in passage)) for k in range(120)]
    made, plain = [], hyper_minhash.cross_pairs

    def counted(*args):
        made.append(plain(*args))
        return made[0]

    monkeypatch.setattr(hyper_minhash, "cross_pairs", counted)
    found = hyper_minhash.near_groups(documents(spark, rows))
    assert collected(found, "doc_id", "n_shingles", "component_id", "kept") == plain_groups(rows)
    assert made[0].count() <= 120 * 119 // 2 // 10


def sketch_rows(spark, pairs):
    sketches = [(len(a), len(b), hyper_minhash.registers(a), hyper_minhash.registers(b)) for a, b in pairs]
    rows = [(na, nb, a.tolist(), b.tolist(), hyper_minhash.marks(a).tolist(), hyper_minhash.marks(b).tolist()) for na, nb, a, b in sketches]
    found = spark.createDataFrame(rows, "na INT, nb INT, sa ARRAY<INT>, sb ARRAY<INT>, ma ARRAY<BIGINT>, mb ARRAY<BIGINT>")
    return found.select("*", *[F.col(f"m{x}")[k].alias(f"m{x}{k}") for x in "ab" for k in range(10)])


def test_no_link_fails_the_estimate(spark):
    """Pairs of exactly the needed similarity pass, pairs of half of it do not."""
    rng = np.random.default_rng(1)
    like, unlike = [], []
    for n in (4, 8, 40, 200, 1000, 5000):
        for _ in range(60):
            every = np.unique(rng.integers(0, 2**64, n + n // 4, dtype=np.uint64))
            like.append((every, np.sort(rng.permutation(every)[:n])))
            if n >= 40:
                unlike.append((every, np.sort(np.concatenate([every[::2], rng.integers(0, 2**64, n // 2, dtype=np.uint64)]))))
    assert sketch_rows(spark, like).where(~hyper_minhash.may_link() | ~hyper_minhash.marks_agree()).isEmpty()
    assert sketch_rows(spark, unlike).where(hyper_minhash.may_link()).isEmpty()


def test_bands_of_similar_sets_meet():
    """No pair of similarity 0.8 among some thousands is without a common band, small sets included."""
    rng = np.random.default_rng(2)
    for n in (4, 8, 9, 20, 100, 700):
        for _ in range(600):
            every = np.unique(rng.integers(0, 2**64, n + n // 4, dtype=np.uint64))
            part = np.sort(rng.permutation(every)[:n])
            x, y = hyper_minhash.dense([hyper_minhash.registers(every), hyper_minhash.registers(part)]).view("<u8")
            assert (x == y).any()


def test_register_holds_leading_zeros_and_mantissa():
    one = hyper_minhash.registers(np.array([(5 << 57) | (0b11 << 40)], dtype=np.uint64))
    # 57 bits behind the bucket: the first one is bit 41, so 15 zeros, and a mantissa of one half
    assert one.tolist() == [5 << 16 | 16 << hyper_minhash.MANTISSA | 1 << (hyper_minhash.MANTISSA - 1)]
    whole = hyper_minhash.dense([one])[0]
    assert whole[4] == (int(whole[5]) + hyper_minhash.JUMP) & 0xFFFF


# ------------------------------------------------------------ filter audit


def failures(text, copy):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = "A" if len(ws) < 200 else ""
    fails += "B" if 100 * len(set(ws)) < 50 * len(ws) else ""
    fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    fails += "D" if re.search(r"[#$%&*|]", text) else ""
    return fails + ("E" if copy else "")


def plain_audit(rows, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        marks[i][0] |= quality == 1
        marks[i][1] |= toxic == 1
    least = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            least[t or ""].append(i)
    docs = defaultdict(list)
    for i, t, lang in rows:
        good, toxic = marks[i] if i is not None else (0, 0)
        docs[lang or ""].append((failures(t or "", i is not None and i > min(least[t or ""])), good, toxic))
    out = Counter()
    for part, every in docs.items():
        table = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = every
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in every) - len(gone)
                table.append((part, order, step, len(left), len(gone), redundant, sum(d[0] == f for d in every), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        for row in table:
            out[(*row[:-1], sum(r[4] for r in table if r[-1] == row[-1]))] += 1
    return out


@pytest.fixture
def audited(spark, odd_rows):  # noqa: F811
    rng = random.Random(4)
    rows = odd_rows + [(400 + k, words(rng, 260) + (" 100%" if k % 3 else "")) for k in range(12)]
    rows += [(500 + k, rows[-1 - k][1]) for k in range(5)] + [(420, "A" * 4000), (421, "é" * 300), (499, rows[-1][1]), (None, rows[-1][1])]
    docs = documents(spark, rows)
    plain = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 520, 3)] + [(3, 1, 1), (3, None, None), (None, 1, 1)]
    return docs, plain, spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT"), labels


def test_filter_audit(audited):
    docs, plain, labels, marks = audited
    found = filter_audit.filter_audit(docs, labels)
    assert collected(found, *filter_audit.COLUMNS) == plain_audit(plain, marks)


def test_swaps_go_through_all_orders():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in filter_audit.swaps(n):
            order[level : level + 2] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))
        assert len(list(filter_audit.swaps(n))) == len(seen) - 1


def test_diagram_after_swaps_is_that_of_the_order():
    rng = random.Random(6)
    weights = {bits: filter_audit.Weight(rng.randrange(9), rng.randrange(3), rng.randrange(3)) for bits in rng.sample(range(32), 20)}
    diagram = filter_audit.Diagram("ABCDE", weights)
    for level in filter_audit.swaps(5):
        diagram.swap(level)
        fresh = filter_audit.Diagram("".join(diagram.order), weights)
        assert list(diagram.steps()) == list(fresh.steps())
        assert diagram.weight[diagram.root] == fresh.weight[fresh.root]


# ------------------------------------------------------------ manifest


def leaf(row, more=0):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    i, source, lang, n, text = row
    return sha(*map(field, (i, source, lang, None if n is None else n + more, text)))


def tree(nodes):
    """Levels from the nodes to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = tree([leaf(r) for r in langs[x]])
    top = tree([trees[x][-1][0] for x in names])
    out = Counter()
    for place, x in enumerate(names):
        for at, r in enumerate(langs[x]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, siblings = leaf(r, int(hit)), []
            for levels, k in ((trees[x], at), (top, place)):
                for level in levels[:-1]:
                    run = level[k // 2 * 2 : k // 2 * 2 + 2]
                    siblings += [h for j, h in enumerate(run) if j != k % 2]
                    run[k % 2] = node
                    node, k = sha(*run), k // 2
            root = top[-1][0]
            out[r[0], leaf(r), trees[x][-1][0], root, sha(*siblings), node, node == root] += 1
    return out


def manifest_rows(spark, odd_rows):  # noqa: F811
    docs = documents(spark, odd_rows + [(7, None), (900, "long " * 20000)])
    extra = documents(spark, [(1000 + k, f"text {k}") for k in range(40)]).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise("日本"))
    docs = docs.unionByName(extra).withColumn("n_chars", F.when(F.col("doc_id") % 10 != 4, F.col("n_chars")))
    # names that the operator has inside
    return docs.withColumns({"tree": F.lit("x"), "at": F.lit(1), "hash": F.lit("y"), "path": F.lit(2), "row": F.lit(0)})


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest(spark, odd_rows, levels):  # noqa: F811
    docs = manifest_rows(spark, odd_rows)
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    plain = plain_manifest([(i, s, la, n, t) for i, s, la, n, t in rows])
    found = merkle.manifest(docs, levels)
    assert collected(found, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == plain


def test_one_leaf_is_its_own_root(spark):
    row = merkle.manifest(documents(spark, [(5, "alone")])).first()
    assert row["leaf"] == row["subroot"] == row["root"]
    assert row["proof_sha256"] == sha("")


def test_empty_tables(spark):
    none = documents(spark, [(1, "x")]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert hyper_minhash.near_groups(none).isEmpty()
    assert merkle.manifest(none).isEmpty()
    assert filter_audit.filter_audit(none, labels).isEmpty()
    assert filter_audit.filter_audit(documents(spark, [(1, "x")]), labels).count() == 600


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    hyper_minhash.near_groups(documents(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
