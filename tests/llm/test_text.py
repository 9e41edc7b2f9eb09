"""BPE, language identification, toxicity, near-duplicates, WARC."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parallaxis.llm import bpe, language, neardup, toxicity, warc
from parallaxis.llm.queries import tokenizer_path
from tests.llm.helpers import documents


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.read_tokenizer(tokenizer_path())


def odd_texts():
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "12", "é", "中", "\x85", " ", "<|endoftext|>", "<|endof", "😀", "!", "_", "Ⅷ"]
    return [None, "", " ", "x" * 5000, "ab " * 9000, *["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)]]


def test_bpe_is_the_library_s(spark, tokenizer):
    from tokenizers import Tokenizer

    texts = odd_texts()
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate([*texts, texts[3]])], clashes=True)
    got = {r.doc_id: r for r in bpe.round_trip(df, tokenizer_path()).collect()}
    library = Tokenizer.from_file(tokenizer_path())
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want, t
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)
    back = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame([(1, [220]), (2, None), (3, [])], "doc_id long, ids array<int>"), tokenizer).collect()}
    assert back == {1: " ", 2: "", 3: ""}


def test_bpe_of_nothing(spark):
    assert bpe.round_trip(documents(spark, []), tokenizer_path()).count() == 0


def test_runs_of_texts_are_the_library_s(tokenizer, tmp_path):
    """Whole runs without Spark, in Arrow arrays, with every kind of white space beside others and alone."""
    from tokenizers import Tokenizer

    spaces, rng = [c for c in map(chr, range(0x3001)) if c.isspace()], random.Random(3)
    parts = ["a", "Wörter", "don't", "ɐ", "ɏ", "12", "x\ny", "<|endoftext|>", "z" * 70, "漢字", "\x00", "\ufeff", "\u200b", " ", " ", " ", *spaces]
    texts = [*odd_texts(), *["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(2_000)]]
    coder, library = bpe.ByteBpe(tokenizer), Tokenizer.from_file(tokenizer_path())
    (tmp_path / "lexicon").write_bytes(bpe.build_lexicon({w: coder.merge(w) for w in (b" a", b" 12", "Wörter".encode())}))
    encoder = bpe.Encoder(coder, bpe.Lexicon(str(tmp_path / "lexicon")))
    for first in range(0, len(texts), 500):
        some = pa.array(["left out", *texts[first : first + 500]], pa.string())[1:]
        ids, at = encoder.encode(some)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[first : first + 500]]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
        assert coder.texts_of(ids, at).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]
    half = [i for i, t in coder.token.items() if t == b"\xc3"]
    assert coder.texts_of(np.array(half * 2, dtype=np.int32), np.array([0, 1, 1, 2])).to_pylist() == ["\ufffd", "", "\ufffd"]


def test_words_of_a_task_are_counted_once(tokenizer):
    """300,000 words in eight batches give a row each, where they gave one in every part that was passed on."""
    from collections import Counter

    coder, text = bpe.ByteBpe(tokenizer), " ".join("".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(300_000))
    batches = [pa.record_batch([pa.array([text, None, "a  b <|endoftext|> it's", "a"])], names=["text"])] * 8
    rows = [r for b in bpe.counted(batches, coder) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = Counter(w for t in (text, "a  b ", " it's", "a") for w in coder.split(t))
    assert len(rows) == len(want) and dict(rows) == {w: 8 * n for w, n in want.items()}


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w: [len(w), i] for i, w in enumerate(sorted({a + b + c for a in (b"x", b"yy", b"") for b in (b"work", b"talk") for c in (b"", b"s", b"ed", b"ing")}))}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.build_lexicon(words))
    lex = bpe.Lexicon(str(path))
    asked = [*words, b"wor", b"works!", b"zzz", b"x"]
    assert [lex.find(w) for w in asked] == [words.get(w) for w in asked]
    assert lex.find_many(asked).tolist() == [sorted(words).index(w) if w in words else -1 for w in asked]
    assert len(lex.start) - 1 < 30  # suffixes are shared: without that, hundreds of states
    path.write_bytes(bpe.build_lexicon({}))
    assert bpe.Lexicon(str(path)).find_many([b"a"]).tolist() == [-1] and bpe.Lexicon(str(path)).find(b"a") is None


SYLLABLES = {"en": ["the", "ing", "er", "wh", "tion"], "de": ["sch", "ung", "ein", "ü", "lich"], "fr": ["eau", "é", "oi", "ment", "ç"]}


def corpus(n=240, toxic=False):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        bad = toxic and i % 4 == 0
        if bad:
            for _ in range(max(2, len(words) // 30)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkface", "zorkhead", "blarg"]))
        rows.append((i, " ".join(words), lang, "s", int(bad)))
    return rows


def test_language(spark):
    rows = [r[:4] for r in corpus()] + [(900, None, None, "s"), (901, "", "en", "s"), (902, "123 !? 4", "en", "s"), (903, "the " * 30_000, None, "s"), (None, "einschung", "de", "s")]
    got = language.identify(documents(spark, [*rows, rows[0]], clashes=True)).collect()
    assert len(got) == len(rows) + 1
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred == lang) for i, _, lang, _ in rows if i is not None and i < 900 and by[i].held_out]
    assert len(held) > 30 and np.mean(held) > 0.95
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[903].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)


def plain_language(model, text):
    """Prediction from the definition: letters, n-grams one by one, TF-IDF, unit length, softmax at the temperature."""
    m32 = (1 << 32) - 1
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    if not low.strip():
        return "und", 0.0
    points = [0, *[0 if c == " " else ord(c) for c in " ".join(low.split())], 0]
    tf = {}
    for i in range(len(points)):
        h = 0
        for k, mult in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            if i + k < len(points):
                h = ((h ^ points[i + k]) * mult) & m32
                h ^= h >> 15
                f = ((h * 0x2C1B3C6D) & m32) >> 17
                tf[f] = tf.get(f, 0) + 1
    x = {f: (1 + np.log(n)) * float(model.idf[f]) for f, n in tf.items()}
    length = sum(v * v for v in x.values()) ** 0.5
    row = lambda f: model.weights.sums(np.array([f]), np.array([1.0]))
    z = sum((v / length) * row(f) for f, v in x.items()) + row(language.FEATURES)
    p = np.exp((z - z.max()) / model.temperature)
    return model.languages[int(p.argmax())], float(p.max() / p.sum())


def test_predictions_are_those_of_plain_arithmetic(spark):
    rows = [r[:4] for r in corpus(80)] + [(900, "İstanbul ΣΑΣ ǅ 中文 \U00020000\U00020001!", "zh", "s"), (901, " a  B\tc ", "en", "s"), (902, None, "en", "s")]
    df = documents(spark, rows)
    model = language.fit(language.learnable(df))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df.select("doc_id", "text"), model).collect()}
    for i, text, *_ in rows:
        want = plain_language(model, text)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-4)


def test_what_is_no_letter_in_any_plane():
    for text in ("123 \U000F0000", "1 \U000E0101", "\U0001F600", "\U000E0041", "\ufe0f \ue000"):
        assert not language.grams(text).size, text
    assert language.grams("\U00020000").size and language.grams("1\U0001D400").size


def test_every_language_is_learned(spark):
    """Many values, each with all the features; the weights hold what isn't zero."""
    rng, rows = random.Random(5), []
    for i in range(1200):
        mark = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
        rows += [(6 * i + j, f"{mark} {mark}" * 3, f"l{i}", "s") for j in range(6)]
    df = documents(spark, rows)
    model = language.fit(language.learnable(df))
    assert len(model.languages) == 1200 and len(model.weights.value) < 0.2 * language.FEATURES * 1200
    assert len(language.fit(language.learnable(df), most_languages=3).languages) == 3
    got = {r.doc_id: r.lang_pred for r in language.predict(df.where("doc_id % 6 = 0").select("doc_id", "text"), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang, _ in rows if i in got]) > 0.5
    assert len(set(got.values())) > 600


def test_language_learns_from_texts_with_a_language_alone(spark):
    rows = [r[:4] for r in corpus(80)]
    more = [(1000 + i, "qxq zzz " * 40, None, "s") for i in range(300)]
    alone, beside = (language.fit(language.learnable(documents(spark, d))) for d in (rows, [*more, *rows]))
    assert (alone.idf == beside.idf).all() and (alone.weights.value == beside.weights.value).all() and alone.temperature == beside.temperature


def test_language_with_rows_that_share_an_id(spark):
    """Most rows have the id that any sample by ids takes or leaves as one; equal rows count once, in any order."""
    rows = [(7, r[1], r[2], "s") for r in corpus(200)] + [(3, "einschung lich", "de", "s")] * 500 + [(5, "eau oi ment", "fr", "s"), (6, "the whing", "en", "s")]
    one, other = (language.fit(documents(spark, d).select("doc_id", "text", "lang"), per_language=60) for d in (rows, rows[::-1]))
    assert one.languages == ("de", "en", "fr") and (one.weights.value == other.weights.value).all() and (one.weights.column == other.weights.column).all()
    assert one.predict("the wh thetion")[0] == "en" and one.predict("schung ein")[0] == "de"


def test_sparse_rows():
    dense = np.random.default_rng(2).standard_normal((9, 5)) * (np.random.default_rng(3).random((9, 5)) < 0.4)
    rows, x = np.array([3, 8, 3, 0]), np.array([1.0, -2.0, 0.5, 4.0])
    assert np.allclose(language.Sparse.of(dense).sums(rows, x), x @ dense[rows], atol=1e-6)
    assert language.Sparse.of(np.zeros((4, 0))).sums(rows[:0], x[:0]).size == 0


def test_language_of_nothing(spark):
    assert language.identify(documents(spark, [])).count() == 0
    assert [r.lang_pred for r in language.identify(documents(spark, [(1, "abc", None, "s")])).collect()] == ["und"]


def test_temperature_and_ftrl():
    logits = np.array([[4.0, 0.0], [0.0, 4.0]] * 10)
    right, wrong = np.array([0, 1] * 10), np.array([0, 1] * 8 + [1, 0] * 2)
    assert language.fit_temperature(logits, right) < 0.6 < language.fit_temperature(logits, wrong)
    w = language.fit_ftrl([(np.array([3]), np.array([1.0], np.float32), 0), (np.array([5]), np.array([1.0], np.float32), 1)] * 20, 2)
    assert w[3, 0] > 0 > w[3, 1] and w[5, 1] > 0 and not w[7].any()


def test_gradient_of_the_network():
    p = {k: v.astype(np.float64) for k, v in toxicity.init().items()}
    corpus = toxicity.Corpus(iter([(1, [b"the", b"zork", b"of"]), (0, [b"a"]), (1, [b"la", b"the", b"die", b"und"])]))
    words, at, mask = corpus.windows(np.arange(3))
    rows, y = corpus.rows(words), np.array([1, 0, 1.0])
    _, g = toxicity.loss_and_gradient(p, rows, at, mask, y)
    rng = np.random.default_rng(0)
    for k in p:
        places = np.argwhere(np.abs(g[k]) > 1e-6)
        for ix in map(tuple, places[rng.permutation(len(places))[:3]]):
            kept, e = p[k][ix], 1e-3
            p[k][ix] = kept + e
            up = toxicity.loss_and_gradient(p, rows, at, mask, y)[0]
            p[k][ix] = kept - e
            down = toxicity.loss_and_gradient(p, rows, at, mask, y)[0]
            p[k][ix] = kept
            assert (up - down) / 2 / e == pytest.approx(g[k][ix], rel=0.02, abs=1e-5)


def test_all_windows_are_scored():
    scorer = toxicity.Scorer(toxicity.init())
    words = [f"w{i}".encode() for i in range(150)]
    starts = [*range(0, 150 - toxicity.WINDOW, toxicity.STRIDE), 150 - toxicity.WINDOW]
    one = scorer.windows([words[s : s + toxicity.WINDOW] for s in starts])
    found = scorer.documents([" ".join(w.decode() for w in words), None, "", "w1 w2"])
    assert found[0, 2] == len(starts) and found[0, 0] == pytest.approx(one.max(), abs=1e-5) and found[0, 3] == starts[int(one.argmax())]
    assert found[1, 2] == found[2, 2] == 0 and found[3, 0] == pytest.approx(scorer.windows([[b"w1", b"w2"]])[0], abs=1e-5)
    many = toxicity.Scorer(toxicity.init()).documents([" ".join(f"w{i}" for i in range(k, k + 70)) for k in range(0, 4000, 40)])
    alone = scorer.documents([" ".join(f"w{i}" for i in range(400, 470))])
    assert many[10, 0] == pytest.approx(alone[0, 0], abs=1e-5)


def plain_window(p, words):
    """The logit of one window, word by word in double precision, from the definition of the network."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, h = {k: v.astype(np.float64) for k, v in p.items()}, toxicity.HIDDEN
    x = []
    for w in words:
        word_row, gram_row, _ = toxicity.hashed([w])
        x.append(np.concatenate([p["word"][word_row[0]], p["char"][gram_row].mean(axis=0) if len(gram_row) else np.zeros(toxicity.CHAR_DIM)]))
    states = {}
    for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        state, own = np.zeros(h), {}
        for t in order:
            a = x[t] @ p[f"wx{side}"] + p[f"b{side}"]
            zr = sig(a[: 2 * h] + state @ p[f"uzr{side}"])
            c = np.tanh(a[2 * h :] + (zr[h:] * state) @ p[f"uh{side}"])
            state = own[t] = state + zr[:h] * (c - state)
        states[side] = own
    s = np.array([np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(x))])
    weight = np.exp(s @ p["att"] - (s @ p["att"]).max())
    return (weight / weight.sum()) @ s @ p["out"] + p["bias"][0]


def test_scores_are_those_of_plain_recurrence(spark):
    """Every document's score against one window after the other, without batches, memo or hashing of many words at once."""
    rows = corpus(60, toxic=True)
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int")
    df = documents(spark, [r[:4] for r in rows] + [(70, "one", "en", "s"), (71, "w " * 77, "en", "s")])
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.window_scores(df, model).collect()}
    mean, scale, weight, constant = model.final
    for i, text, *_ in [*rows[::5], (70, "one"), (71, "w " * 77)]:
        words = toxicity.words_of(text)
        starts = sorted({*range(0, max(len(words) - toxicity.WINDOW, 0) + 1, toxicity.STRIDE), max(len(words) - toxicity.WINDOW, 0)})
        logit = np.array([plain_window(model.parameters, words[s : s + toxicity.WINDOW]) for s in starts])
        x = np.array([np.clip(logit.max(), -12, 12), (1 / (1 + np.exp(-logit))).mean(), np.log1p(len(logit))])
        want = 1 / (1 + np.exp(-((x - mean) / scale @ weight + constant)))
        assert got[i].windows == len(starts) and got[i].score == pytest.approx(want, abs=2e-4)


def test_windows_of_whole_texts_are_learned_from():
    words = [f"w{i}".encode() for i in range(5000)]
    c = toxicity.Corpus(iter([(1, words), (0, words[:40]), (0, [])]))
    seen = {int(w) for k in range(len(c.start)) for w in c.windows(np.array([k]))[0]}
    assert seen == set(range(5000)) and c.toxic.tolist() == [1, 0]
    for a, b in zip(c.rows(np.array([7, 3])), toxicity.hashed([b"w7", b"w3"]), strict=True):
        assert sorted(a.tolist()) == sorted(b.tolist())


def test_a_toxic_passage_deep_in_a_long_text_is_learned(spark):
    """The only toxic words lie beyond any prefix; ids that repeat are learned from by their smallest text, in any order of rows."""
    rng, rows = random.Random(3), []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(1500 if i % 2 else 40)]
        if toxic := i % 4 == 1:
            words[1203:1203] = [rng.choice(["zorkface", "zorkhead"]) for _ in range(4)]
        rows.append((i, " ".join(words), "en", "s", int(toxic)))
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int")
    docs = [r[:4] for r in rows] + [(3, "zzz other text", "en", "s")]
    one, other = (toxicity.fit(documents(spark, d), labels) for d in (docs, docs[::-1]))
    assert all((one.parameters[k] == other.parameters[k]).all() for k in one.parameters)
    got = {r.doc_id: r.score for r in toxicity.window_scores(documents(spark, [r[:4] for r in rows]), one).collect()}
    assert np.mean([got[r[0]] >= 0.7 for r in rows if r[4]]) > 0.9 and np.mean([got[r[0]] >= 0.7 for r in rows if not r[4]]) < 0.1


def test_sample_of_texts_is_bounded():
    assert toxicity._fitting([(1, 0, 5), (2, 0, 50), (3, 1, 7), (4, 0, 5), (5, 0, 1)], (10, 7)) == [1, 3, 4]


def test_toxicity(spark):
    rows = corpus(400, toxic=True)
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    more = [(900, None, None, "s"), (901, "", "en", "s"), (902, "!!", "en", "s"), (903, "the " * 50_000, "en", "s"), (None, "the", "en", "s")]
    got = toxicity.score_documents(documents(spark, [r[:4] for r in rows] + more + [rows[0][:4]], clashes=True), labels).collect()
    assert len(got) == len(rows) + 6
    by = {r.doc_id: r for r in got}
    held = [(by[r[0]].predicted, r[4]) for r in rows if by[r[0]].held_out]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.05
    assert all(by[i].score == 0 for i in (900, 901, 902)) and all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_documents(documents(spark, [(1, "a b", "en", "s")]), none).collect()] == [0.0]
    assert toxicity.score_documents(documents(spark, []), none).count() == 0


def brute_components(rows, k=3, percent=85):
    sets = []
    for _, t in rows:
        w = tuple((t or "").encode().lower().split())
        sets.append({w[i : i + k] for i in range(len(w) - k + 1)} if len(w) >= k else ({w} if w else set()))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)]


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([1, 2, 3, 40, 90]))]
        for _ in range(rng.choice([1, 1, 4, 14])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            rows.append((n, (" ".join(text)).upper() if rng.random() < 0.2 else " \t".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_match_brute_force(spark, seed):
    rows = near_copies(seed) + [(800, None), (801, ""), (802, " \n"), (803, None), (804, "long " * 40_000)]
    rows += [rows[0]]
    df = documents(spark, [(d, t, "en", "s") for d, t in rows], clashes=True)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == sorted(brute_components(rows))
    kept = neardup.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({d for d, _, _, k in got if k}) and {r.t for r in kept.select("t").distinct().collect()} == {7}


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.without_near_duplicates(documents(spark, [])).count() == 0


def test_equal_bits_estimate(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    m = neardup.minima([np.sort(a), np.sort(b)])
    s = neardup.packed(m)
    low = (m >> np.uint64(20)) & np.uint64(15)
    df = spark.createDataFrame([(*map(int, s[0]), *map(int, s[1]))], ", ".join(f"{x}{i} long" for x in "ab" for i in range(4)))
    df = df.select(F.struct(*[F.col(f"a{i}").alias(f"s{i}") for i in range(4)]).alias("x"), F.struct(*[F.col(f"b{i}").alias(f"s{i}") for i in range(4)]).alias("y"))
    equal, share = df.select(neardup.equal_minima("x", "y"), neardup.estimate(neardup.equal_minima("x", "y"))).first()
    assert equal == int((low[0] == low[1]).sum()) and abs(share - 1800 / 2200) < 0.2


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("top", F.lit(1))


def test_warc(spark):
    rows = [(1, "http://a", "same"), (5, "http://b\r\nX: y", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 3), (7, "u", "x" * 3_000_000), (8, "u", "own"), (8, "u", "own"), (None, "u", "own")]
    got = warc.archive_pages(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    for r in got:
        html = next((h or "") for i, _, h in rows if i == r.page_id).encode()
        assert r.payload_bytes == len(html) and r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
        best = top[html.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == best else ("revisit", best))
    large = warc.archive_pages(pages(spark, rows), least_bytes=5).collect()
    assert {r.record_type for r in large} == {"response"}
    assert warc.archive_pages(pages(spark, []).where("page_id > 0")).count() == 0


def test_normaliser_makes_members_of_a_monolithic_stream():
    records = [warc.make_record(i, "u", b"p" * (i * 70_000), None, False).bytes() for i in range(4)]
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), out, index) == 4
    import json

    for line, record in zip(index.getvalue().splitlines(), records, strict=True):
        at = json.loads(line)
        assert gzip.decompress(out.getvalue()[at["offset"] : at["offset"] + at["length"]]) == record
    for bad in (gzip.compress(b"".join(records))[:-9], gzip.compress(records[1][:-2]), gzip.compress(b"junk\r\n\r\n")):
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(bad), io.BytesIO(), io.BytesIO())


def test_toxicity_of_two_models_in_one_session(spark):
    """Workers that Spark uses again don't score with what they kept of another model."""
    texts = corpus(160, toxic=True)
    docs = documents(spark, [r[:4] for r in texts])
    labels = lambda of: spark.createDataFrame([(r[0], 1, of(r)) for r in texts], "doc_id long, quality int, toxic int")
    one, two = toxicity.fit(docs, labels(lambda r: r[4])), toxicity.fit(docs, labels(lambda r: int(r[2] == "de")))
    assert one.key != two.key
    score = lambda m: {r.doc_id: r.score for r in toxicity.window_scores(docs.coalesce(1), m).collect()}
    for model in (one, two, one, two):
        want = model.score(toxicity.Scorer(model.parameters).documents([r[1] for r in texts]))
        got = score(model)
        assert all(got[r[0]] == pytest.approx(w, abs=1e-5) for r, w in zip(texts, want, strict=True))
