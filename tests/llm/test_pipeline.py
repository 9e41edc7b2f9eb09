"""The pipeline against a plain version in Python, and on what a table may hold."""

import hashlib
import random

import corpus_pipeline
from parallaxis.llm import language, mixing, neardup, toxicity
from parallaxis.llm.queries import tokenizer_path
from tests.llm.helpers import documents
from tests.llm.test_text import brute_components, corpus


def written(spark, tmp_path, rows, labels):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "bpe"]


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    made = corpus(300, toxic=True)
    rng = random.Random(1)
    rows = [(i, t, lang, rng.choice("aab") if i % 9 else None) for i, t, lang, _, _ in made]
    rows += [(1000 + i, rows[i][1], "en", "a") for i in range(0, 60, 3)] + [(2000, None, None, None), (2001, "", None, "a"), (2002, "123", "en", "b"), rows[1]]
    sf = written(spark, tmp_path, rows, [(r[0], 1, r[4]) for r in made])
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {(r.doc_id): r.score for r in toxicity.window_scores(docs.select("doc_id", "text"), toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    left = [r for r in rows if scores[r[0]] < 0.7]
    model = language.fit(language.learnable(documents(spark, left)))
    left = [r for r in left if model.predict(r[1])[0] != "und" and model.predict(r[1])[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    left = list(dict.fromkeys(left))
    keep = {d for d, _, _, k in brute_components([(r[0], r[1]) for r in left]) if k}
    left = [r for r in left if r[0] in keep]
    reps = {r.doc_id: r.reps for r in mixing.mix(documents(spark, left)).collect()}
    library = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in left:
        ids = library.encode(r[1], add_special_tokens=False).ids
        want += [(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * reps[r[0]]
    assert got == sorted(want) and got


def test_stages_keep_the_columns_and_bear_clashes(spark, tmp_path):
    made = corpus(120, toxic=True)
    sf = written(spark, tmp_path, [r[:4] for r in made], [(r[0], 1, r[4]) for r in made])
    docs = documents(spark, [r[:4] for r in made], clashes=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        other = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert all(float(v) == 7 for v in out.select(*other).first())


def test_near_duplicates_share_four_fifths_of_five_word_shingles(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(0, 90, 3):
        base = [word() for _ in range(200)]
        at, edited = rng.randrange(20, 180), list(base)
        for j in (30, 80, 130, 180)[: 1 + i % 4]:
            edited[j] = word()
        inserted = base[:at] + [word() for _ in range(30 + i % 19)] + base[at:]  # from 0.77 to 0.85 similar
        rows += [(i, " ".join(base)), (i + 1, " ".join(inserted)), (i + 2, " ".join(edited))]
    want = {d for d, _, _, kept in brute_components(rows, 5, 80) if kept}
    assert want != {d for d, _, _, kept in brute_components(rows) if kept}
    got = corpus_pipeline.without_near_duplicates(spark, documents(spark, [(d, t, "en", "s") for d, t in rows]), "")
    assert {r.doc_id for r in got.collect()} == want


def test_bands_miss_few_pairs_at_the_threshold():
    assert [neardup.band_rows(p) for p in (80, 85)] == [3, 4]
    for percent in range(20, 100):
        n = neardup.band_rows(percent)
        assert (1 - (percent / 100) ** n) ** (neardup.HASHES // n) <= neardup.MISSED


def test_last_stage_keeps_the_token_ids(spark):
    from tokenizers import Tokenizer

    rows = [(1, "Ein Satz, then another.", "de", "s"), (2, "", "en", "s"), (3, "word " * 3000, "en", "s")]
    library = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in corpus_pipeline.encoded(spark, documents(spark, rows), "").collect()}
    assert {d: (r.ids, r.decoded, r.n_tokens) for d, r in got.items()} == {d: (ids := library.encode(t, add_special_tokens=False).ids, t, len(ids)) for d, t, _, _ in rows}


def test_empty_tables_pass(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0
