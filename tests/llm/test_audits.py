"""Decontamination, the Merkle manifest and the divergence of sources, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.llm import divergence, merkle, queries, suffixes
from tests.llm.helpers import ascii_lower, documents

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, ascii_lower(text or ""))


# op11


def brute_hits(text, items, window=10):
    """(words, places that are hit, ids of items with an occurring window)."""
    w, hit, ids = words_of(text), set(), set()
    for item, item_text in items:
        i = words_of(item_text)
        n = min(window, len(i))
        windows = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                ids |= {str(item)} if item is not None else set()
    return len(w), hit, ids


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)).withColumn("spans", F.lit("x"))


def contaminated_corpus(seed, alphabet, n_items=25, n_docs=60):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(alphabet, k=n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 14, 40]))) for i in range(n_items)] + [(None, say(12)), (3, say(20)), (100, None), (101, "..."), (20, "Ab é-AB É é x")]
    docs = []
    for i in range(n_docs):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = words_of(rng.choice(items)[1])
            a = rng.randint(0, max(len(w) - 1, 0))
            parts += [", ".join(w[a : a + rng.randint(1, 25)]).upper(), say(rng.randint(0, 12))]
        docs.append((i, " ".join(parts), "en", "s"))
    return [*docs, (900, None, "en", "s"), (901, "", "en", "s"), (902, "ab é ab É é x", "en", "s"), docs[3], docs[3], (None, docs[4][1], None, None)], items


@pytest.mark.parametrize(("seed", "alphabet", "block_words"), [(1, "abcdefgh", 250_000), (2, [f"w{i}" for i in range(60)], 250_000), (3, "ab", 60), (4, [f"w{i}" for i in range(40)], 90)])
def test_contamination(spark, seed, alphabet, block_words):
    docs, items = contaminated_corpus(seed, alphabet)
    got = suffixes.contamination(documents(spark, docs, clashes=True), benchmark(spark, items), block_words=block_words).collect()
    assert len(got) == len(docs)
    want = Counter()
    for i, text, *_ in docs:
        n, hit, ids = brute_hits(text, items)
        want[(i, n, tuple(sorted(hit)), tuple(sorted(ids)))] += 1
    assert Counter((r.doc_id, r.n_words, tuple(p for s in r.spans for p in range(s.first, s.first + s.words)), tuple(r["items"])) for r in got) == want
    assert all(r.n_hit == sum(s.words for s in r.spans) and all(s.longest >= 1 for s in r.spans) for r in got)


def test_matching_in_small_runs(monkeypatch):
    """The longest match goes on from one run of a text to the next, and items are cut into pieces without losing a window."""
    rng = random.Random(5)
    item = [b"w%d" % rng.randrange(30) for _ in range(300)]
    text = b" ".join([b"x y", *item[20:220], b"z", *item[:7], b"q", *item[250:]])
    whole = suffixes.Matcher(suffixes.build([(0, "0", item)]), ["0"]).match(text)
    assert (2, 200, 200) in whole[1] and whole[0] == 2 + 200 + 1 + 7 + 1 + 50
    monkeypatch.setattr(suffixes, "RUN_BYTES", 16)
    assert suffixes.Matcher(suffixes.build([(0, "0", item)]), ["0"]).match(text) == whole


def test_pieces_of_long_items(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices([f"w{i}" for i in range(500)], k=n))
    item = say(400)
    w = item.split()
    docs = [(i, " ".join(w[a : a + 12]), "en", "s") for i, a in enumerate(range(0, 388, 7))]
    made = suffixes.automata(benchmark(spark, [(1, item), (1, item)]), piece_words=50).collect()
    found = [suffixes.Matcher({k: np.frombuffer(bytes(x), dtype=t) for k, t, x in zip(r["names"], r["kinds"], r["arrays"])}, r["ids"]) for r in made]
    for _, text, *_ in docs:
        spans = []
        for m in found:
            spans = suffixes.united(spans, m.match(text.encode())[1])
        assert [(a, n) for a, n, _ in spans] == [(0, 12)]


def test_decontaminated(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Keep this, {passage.upper()}! and that. " + "more words here " * 10, "en", "s"), (2, passage, "en", "s"), (3, None, "en", "s"), (4, "a short ten", "en", "s"), (5, f"é {passage} " + "ü " * 30, "en", "s")]
    docs = documents(spark, rows, clashes=True)
    got = suffixes.decontaminated(docs, benchmark(spark, [(7, passage), (8, "short ten")]))
    assert got.columns == docs.columns
    texts = {r[0]: r[1] for r in got.collect()}
    assert texts == {1: "Keep this, ! and that. " + "more words here " * 10, 3: None, 5: "é  " + "ü " * 30}  # 2 is hit as a whole, 4 for two thirds
    kept = suffixes.decontaminated(docs, benchmark(spark, [(7, passage), (8, "short ten")]), most_coverage=1.0).collect()
    assert {r[0]: r[1] for r in kept}[4] == "a short ten"


def test_contamination_of_nothing(spark):
    none = benchmark(spark, [(1, None)])
    assert suffixes.contamination(documents(spark, []), none).count() == 0
    r = suffixes.contamination(documents(spark, [(1, "a b", None, None)]), none.limit(0)).first()
    assert (r.n_words, r.n_hit, r.spans, r["items"]) == (2, 0, [], [])
    assert suffixes.decontaminated(documents(spark, [(1, "a b", None, None), (2, "", None, None)]), none).count() == 2


# op12


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(value, (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """(root, siblings of each leaf from below, as (before, after))."""
    nodes, paths, under = list(leaves), [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        ups, unders = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in under[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            ups.append(H(*run))
            unders.append([i for u in under[a : a + 16] for i in u])
        nodes, under = ups, unders
    return nodes[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); what op12 returns, in a Counter."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = plain_tree([trees[s][0] for s in sources])
    out = Counter()
    for s, top in zip(sources, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = [*path, *top]
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                at = plain_leaf(*r[:4], None if r[4] is None else ascii_lower(r[4]))
            for before, after in path:
                at = H(before, at, after)
            out[(r[0], leaf, trees[s][0], root, H(*[b + a for b, a in path]), at, at == root)] += 1
    return out


def source_rows(sizes, seed=0):
    rng, i, rows = random.Random(seed), 0, []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, rng.choice(["Ab", "c", "", None, "é" * 3 + "Z", "x" * 2000]), rng.choice(["en", None]), s))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, None: 5, "B": 1, "é": 16}, {"big": 700, "": 3, None: 257, "c": 256, "d": 272}, {f"s{k}": 2 for k in range(40)}])
@pytest.mark.parametrize("levels", [2, 3])
def test_merkle(spark, tmp_path, monkeypatch, sizes, levels):
    if levels == 3 and len(sizes) > 5:
        pytest.skip("as with two levels")
    whole = merkle.with_paths
    monkeypatch.setattr(merkle, "with_paths", lambda leaves: whole(leaves, levels))
    rows = source_rows(sizes)
    rows += [(None, "A", "en", "a"), (None, None, None, "a"), rows[0], rows[0], (rows[0][0], "other", None, rows[0][3])] * (levels == 2)
    documents(spark, rows, clashes=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    want = plain_manifest([(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows])
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == want
    assert {r.verified for r in got} == {True, False} or len(rows) < 10


def test_merkle_sql(spark, tmp_path):
    import duckdb

    rows = [*source_rows({"a": 300, None: 20, "b": 1, "É": 33}), (None, "A", "en", "a")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.oracle()})").fetchall()
    assert Counter(got) == plain_manifest([(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows])


def test_merkle_of_many_equal_rows_and_many_partitions(spark):
    """A source of equal rows, over more tasks than there are sources."""
    rows = [(1, "same", "en", "hot")] * 600 + [(i, str(i), "en", f"s{i % 3}") for i in range(60)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = merkle.manifest(documents(spark, rows).repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len(got) == len(rows)
    root = plain_manifest([(i, s, lang, len(t), t) for i, t, lang, s in rows])
    assert {r.root for r in got} == {k[3] for k in root}
    for r in got:
        at = r.leaf
        for step in r.path:
            at = H(step.before, at, step.after)
        assert at == r.root


def test_merkle_of_nothing(spark):
    assert merkle.manifest(documents(spark, [])).count() == 0


def test_traversal_holds_little():
    """Beside the leaves, which it asks for one by one, it holds a few runs."""
    leaves = [H(str(i)) for i in range(3000)]
    t = merkle.Traversal(leaves.__getitem__, len(leaves), 3)
    root, paths = plain_tree(leaves)
    for i, path in enumerate(t.paths()):
        assert path == paths[i]
        held = sum(map(len, t.existing)) + sum(len(nodes) for run in t.desired for nodes in run.stack)
        assert held <= 3 * 16 + (1 + 2 + 3) * 16
    assert t.root() == root


# op13


def plain_audit(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t or "")), lang or "", s or "") for t, lang, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        seen = Counter(w for words, _, _ in own for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= least)
        count = {s: Counter() for s in {r[2] for r in own}}
        for words, _, s in own:
            count[s].update(w for w in words if w in set(kept))
        rate = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: rate(c) for s, c in count.items()}, rate(sum(count.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in count if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] > 0 and p[s][w] > q[w]]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(sorted(terms)[:top])}
    return out


def audited(df):
    got = [tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefg" for b in ("x", "É", "é", "𝔞", "")] + ["A1B", "it's", "a_b"]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.randint(0, 25))
        rows.append((i, rng.choice([" ", "-", "9"]).join(words).replace("x", rng.choice("xX")), rng.choice(["en", "de", None, "zz"]), rng.choice(["s1", "s2", "é", None, "S1"])))
    rows += [(900, None, "en", "empty"), (901, "", "xx", "one"), (902, "a b", "xx", "two"), (903, "a", "xx", None), (904, "word " * 20_000, "en", "s1"), (905, "tie tie", "yy", "s"), rows[0], rows[0]]
    assert audited(documents(spark, rows, clashes=True)) == plain_audit([(t, lang, s) for _, t, lang, s in rows])


def test_divergence_counts_beyond_a_long(spark):
    r = spark.createDataFrame([(4 * 10**12, 9 * 10**12, 5)], "n long, total long, v long").select(divergence._rate("n", "total").alias("p")).first()
    assert r.p == 1 + 10**9 * (4 * 10**12 + 2) // (9 * 10**12 + 10)


def test_divergence_of_nothing_and_of_one(spark):
    assert audited(documents(spark, [])) == set()
    assert audited(documents(spark, [(1, "a", "en", "s")] * 12)) == set()
    got = audited(documents(spark, [(1, "a a b", "en", "s")] * 12 + [(2, None, "en", "t")]))
    assert {g[:4] for g in got if g[2] == "pair"} == {("en", "s", "pair", "t"), ("en", "t", "pair", "s")}
