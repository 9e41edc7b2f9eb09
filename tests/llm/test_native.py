"""License scans, chat formatting and mixing."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parallaxis.llm import chat, licenses, mixing
from tests.llm.helpers import ascii_lower, documents


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    starts = {}
    for t in licenses.TEMPLATES:
        n = len(t.key)
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) == t.key:
                starts.setdefault(t, []).append(i)
    base = [i for t, s in starts.items() if t.base for i in s]
    share = max([sum(0 <= i - t.key_at + j < len(words) and words[i - t.key_at + j] == w for j, w in enumerate(t.words)) / len(t.words) for t, s in starts.items() for i in s], default=0.0)
    join = lambda ts: ",".join(sorted({t.label for t in ts}))
    return len(words), len(base), min(base, default=None), max(base, default=None), join(t for t in starts if t.base), join(starts), share


TEXTS = [
    None, "", "  ", "MIT License", "mit-LICENSE mit license!", "The Apache\nLicense, Version 2.0", "GNU General Public License v3 é MIT Licensé", "mit x license", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
    "word " * 5000 + "apache license", "Permission is hereby granted, free of charge, to any person", "İstanbul MİT license", "general public general public license",
]


def test_license_scan_matches_brute_force(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate([*TEXTS, TEXTS[3]])]
    got = licenses.scan_licenses(documents(spark, rows, clashes=True)).orderBy("doc_id").collect()
    for r, (_, text, _, _) in zip(got, rows, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_licenses(text), text


def test_license_scan_with_many_templates(spark):
    """An index of 200 templates with words in common, and other numbers of lookups."""
    rng = random.Random(6)
    phrase = lambda n: " ".join(rng.choices("abcdefgh", k=n))
    made, seen = list(licenses.BASE), set()
    while len(made) < 200:
        whole = phrase(rng.randint(3, 9)).split()
        at, n = rng.randrange(len(whole) - 1), rng.randint(2, 4)
        made.append(licenses.template(f"l{len(made)}", " ".join(whole), " ".join(whole[at : at + n])))
    rows = [(i, phrase(rng.randint(0, 60)), "en", "s") for i in range(60)] + [(100, "mit license " * 3000, "en", "s")]
    kept, licenses.TEMPLATES = licenses.TEMPLATES, tuple(made)
    try:
        want = [brute_licenses(t) for _, t, _, _ in rows]
    finally:
        licenses.TEMPLATES = kept
    for lookups in (1, 3):
        got = licenses.scan_licenses(documents(spark, rows), tuple(made), lookups).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got] == want
        assert got[-1].matches[0].starts == list(range(0, 6000, 2))


def test_license_scan_of_nothing(spark):
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def messages(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("parts", chat.text_part(F.col("text")))


def test_chat_reads_back_what_went_in(spark):
    alphabet = ["<", "|", "turn", "end", ">", "&", "amp;", "lt;", "[", "INST", "]", "\n", "\\", "é", "😀", "&lsqb;", "</s>", "a "]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "<|end|>\n", None]), rng.choice([None, "", "".join(rng.choices(alphabet, k=rng.randint(1, 9)))])) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(60, 1, "user", x) for x in ("[x", "<a", "1a", "Zz", "&", "[", "1a")] + [(60, 1, "User", "b"), (60, None, "user", "[")]
    rows += [(99, 0, "user", "x" * 200_000), (99, None, "assistant", "<|end|>\n"), (None, 1, "user", "a"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a")]
    out = chat.format_chats(messages(spark, rows)).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == len({r[0] for r in rows})
    for r in out:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, _, role, text in own]
        assert r.loss == "".join(text for _, _, role, text in own if role == "assistant")
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>\n") == len(own)


def test_chat_bears_other_columns(spark):
    rows = messages(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")])
    clash = rows.select("*", F.lit(3).alias("Turn"), F.lit(7).alias("Role"), F.lit(1).alias("body"), F.lit(2).alias("t"))
    assert clash.count() == 2 and chat.format_chats(clash).first() == chat.format_chats(rows).first()


def test_chat_parts(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", [("text", "see [", None, None), ("image", None, "i.png", 10), ("audio", None, "a.wav", None), ("text", None, None, None), ("document", "ignored", "d.pdf", None)]), (1, 1, "assistant", None)],
        f"conv_id long, turn long, role string, parts array<{chat.PART}>",
    )
    r = chat.format_chats(df).first()
    assert r.formatted == "<|turn|>user\nsee &lsqb;<|image|><|audio|><|document|><|end|>\n<|turn|>assistant\n<|end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "i.png", 10), (1, "audio", "a.wav", 250), (2, "document", "d.pdf", 1024)]
    assert r.attachment_tokens == 1284
    assert chat.format_chats(df.limit(0)).count() == 0


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), epochs=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free}
        over = [s for s in free if target[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return {**capped, **target}
        capped |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "tiny"]
    rows = [(i, "w " * rng.randint(1, 30), "en", rng.choices(names, [40, 10, 5, 3, 10, 1])[0]) for i in range(600)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "nothing"), (1002, "x", "en", "tiny"), (1003, " a\tb\x0bc d ", "en", "b"), rows[0], rows[0]]
    got = mixing.mix(documents(spark, rows, clashes=True)).collect()
    assert len(got) == len(rows)
    sizes, taken, most = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size * (3 if r.doc_id == rows[0][0] else 1))
        assert r.taken <= 3 * r.size and r.taken == r.reps * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6, s
    again = mixing.mix(documents(spark, list(reversed(rows)))).collect()
    key = lambda r: (r.doc_id, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert {r.size for r in got if r.doc_id == 1003} == {3}
    emitted = mixing.mixed_rows(documents(spark, rows, clashes=True))
    assert emitted.columns == documents(spark, rows, clashes=True).columns
    assert emitted.count() == sum(r.reps for r in got) and {r.h for r in emitted.select("h").distinct().collect()} == {7}


def test_mixing_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(documents(spark, [(1, None, None, None), (2, "", None, "a")])).collect()} == {0}


def test_chat_query_digests(spark, tmp_path):
    from parallaxis.llm import queries

    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a[")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, -7}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\na[\n").hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert (got[-7].loss_chars, got[-7].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
