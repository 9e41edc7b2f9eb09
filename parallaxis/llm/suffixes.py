"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Items become words (A-Z lower-cased; ASCII characters other than letters and digits stand between them) and are dealt into blocks of
about BLOCK_WORDS words by a hash; long items are cut into pieces that overlap by one window less a word, so no window is lost.
Each block's automaton is built in a task of its own. Documents stream their words through it: the state and the length of the longest
match that ends at a word are known at every word, and where the length reaches WINDOW the last WINDOW words are a window of the items
of the state (or of its suffix that has this length); an item of fewer words is one window and is met as a suffix of the state.
Words of windows are hit. One automaton is sent to the workers at a time for each pass over the documents; hits of all
blocks are united within the row, so no documents are shuffled and any number of items is borne.

Texts are read whole, in runs of RUN_BYTES that break between words. Null and empty texts have no words; documents and items without words
hit nothing. Rows without an item_id make hits but are not listed; equal item_ids are one item. Repeated rows each get their row, an empty
table gives an empty result, without items nothing is hit. Other columns are ignored (contamination) or kept (decontaminated).
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, ascii_lower, discard, pick, resident, text_batches, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words of items in an automaton (about 100 bytes of a worker each), and in a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 250_000, 50_000
#: Passes that run in one another, each with an automaton in a worker, before what they found is written.
PASSES_AT_ONCE = 3
RUN_BYTES = 1 << 20

SPAN = "struct<first: bigint, words: bigint, longest: bigint>"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Builder:
    """Extends a suffix automaton of several word sequences by one word at a time."""

    def __init__(self):
        self.after: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.after.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.after) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest word sequence followed by w, parted from longer ones where they shared a state."""
        q = self.after[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, dict(self.after[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.after[p].get(w) == q:
            self.after[p][w] = own
            p = self.link[p]
        return own

    def extend(self, last: int, w: int) -> int:
        if w in self.after[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.after[p]:
            self.after[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new


def build(items: list[tuple[int, str | None, list[bytes]]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Arrays of an automaton of (item number, item_id, words); item numbers count up from 0.

    words, vocabulary: the words' bytes and ends; step_keys, step_to: state * words + word, sorted, and the next state; link, length;
    window_of: of each state the suffix state whose match of window words ends there; owner_ends, owners: items by state;
    short_of, short_ends, short_length, short_item: the same for items of fewer words, whose states form chains by short_of.
    """
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in words] for _, _, words in items]
    b = Builder()
    for words in rows:
        last = 0
        for w in words:
            last = b.extend(last, w)
    n = len(b.after)
    link, length = np.array(b.link, dtype=np.int32), np.array(b.length, dtype=np.int32)
    order = np.argsort(length, kind="stable").tolist()
    window_of = np.full(n, -1, dtype=np.int32)
    for v in order[1:]:
        window_of[v] = v if length[link[v]] < window <= length[v] else window_of[link[v]]
    owned: dict[int, set[int]] = {}
    short: dict[int, set[tuple[int, int]]] = {}
    for (item, _, _), words in zip(items, rows, strict=True):
        v = 0
        for at, w in enumerate(words):
            v = b.after[v][w]
            if at + 1 >= window:
                v = int(window_of[v])
                owned.setdefault(v, set()).add(item)
        if 0 < len(words) < window:
            while length[link[v]] >= len(words):
                v = int(link[v])
            short.setdefault(v, set()).add((len(words), item))
    short_of = np.full(n, -1, dtype=np.int32)
    for v in order[1:]:
        short_of[v] = v if v in short else short_of[link[v]]
    keys = np.array([v * len(number) + w for v in range(n) for w in b.after[v]], dtype=np.int64)
    to = np.array([x for after in b.after for x in after.values()], dtype=np.int32)
    by = np.argsort(keys, kind="stable")
    shorts = [sorted(short[v]) for v in sorted(short)]
    return {
        "words": np.frombuffer(b"".join(number), dtype=np.uint8), "vocabulary": np.cumsum([len(w) for w in number], dtype=np.int64),
        "step_keys": keys[by], "step_to": to[by], "link": link, "length": length, "window_of": window_of,
        "owner_ends": np.cumsum([len(owned.get(v, ())) for v in range(n)], dtype=np.int64), "owners": np.array([i for v in sorted(owned) for i in sorted(owned[v])], dtype=np.int32),
        "short_of": short_of, "short_ends": np.cumsum([len(short.get(v, ())) for v in range(n)], dtype=np.int64),
        "short_length": np.array([k for x in shorts for k, _ in x], dtype=np.int32), "short_item": np.array([i for x in shorts for _, i in x], dtype=np.int32),
        "least": np.array([min([window, *(len(x) for x in rows if x)])], dtype=np.int32),
    }


class Matcher:
    """Streams words through an automaton."""

    def __init__(self, a: dict[str, np.ndarray], ids: list[str | None], window: int = WINDOW):
        raw, ends = a["words"].tobytes(), a["vocabulary"].tolist()
        self.number = {raw[s:e]: i for i, (s, e) in enumerate(zip([0, *ends], ends))}
        self.size, self.least, self.window, self.ids = len(ends), int(a["least"][0]), window, ids
        self.keys, self.to, self.link, self.length = (memoryview(np.ascontiguousarray(a[k])) for k in ("step_keys", "step_to", "link", "length"))
        self.window_of, self.short_of = memoryview(a["window_of"]), memoryview(a["short_of"])
        self.owner_ends, self.owners, self.short_ends = a["owner_ends"], a["owners"], a["short_ends"]
        self.short_length, self.short_item = a["short_length"], a["short_item"]

    def _step(self, v: int, w: int) -> int:
        key = v * self.size + w
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else -1

    def match(self, text: bytes) -> tuple[int, list[tuple[int, int, int]], set[int]]:
        """(words of the text, (first, words, longest match) of each span of hit words, items with a window in it)."""
        n, spans, items, state = 0, [], set(), (0, 0)
        for words in _runs(text):
            ids = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            known = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]])))
            after = (0, 0)
            for a, b in known.reshape(-1, 2).tolist():
                # words that no item has end all matches; between them only so many in a row can hold a window
                if b - a >= self.least or a == 0 or b == len(ids):
                    end = self._walk(ids[a:b].tolist(), n + a, state if a == 0 else (0, 0), spans, items)
                    if b == len(ids):
                        after = end
            n, state = n + len(words), after
        return n, spans, items

    def _walk(self, ids: list[int], first: int, state: tuple[int, int], spans: list, items: set[int]) -> tuple[int, int]:
        v, match = state
        for at, w in enumerate(ids, first):
            to = self._step(v, w)
            while to < 0 and v:
                v = self.link[v]
                match = self.length[v]
                to = self._step(v, w)
            if to < 0:
                continue
            v, match = to, match + 1
            hit = 0
            if match >= self.window:
                hit, u = self.window, self.window_of[v]
                items.update(self.owners[self.owner_ends[u - 1] : self.owner_ends[u]].tolist())
            u = self.short_of[v]
            while u >= 0:
                for k in range(self.short_ends[u - 1], self.short_ends[u]):
                    if self.short_length[k] <= match:
                        hit = max(hit, int(self.short_length[k]))
                        items.add(int(self.short_item[k]))
                u = self.short_of[self.link[u]] if self.link[u] >= 0 else -1
            if hit:
                _add(spans, at - hit + 1, at + 1, match)
        return v, match


def _add(spans: list[tuple[int, int, int]], first: int, end: int, longest: int) -> None:
    """Adds a hit to spans (first, words, longest), which are in order of their ends; those that it touches become one."""
    while spans and spans[-1][0] + spans[-1][1] >= first:
        a, n, most = spans.pop()
        first, end, longest = min(a, first), max(a + n, end), max(most, longest)
    spans.append((first, end - first, longest))


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, so many bytes at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = len(text) if at + RUN_BYTES >= len(text) else text.find(b" ", at + RUN_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def united(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for first, n, longest in sorted([*a, *b]):
        _add(out, first, first + n, longest)
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """block, ids (of the items by number), and the arrays of the automaton of the block's items."""
    lower = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    items = items.where(F.size("words") > 0)
    blocks = max(1, -(-(items.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(piece_words))
    pieces = items.select("item_id", "words", F.explode(starts).alias("start"))
    pieces = pieces.select("item_id", F.slice("words", F.col("start") + 1, piece_words + window - 1).alias("words")).distinct()
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", F.array_join(F.slice("words", 1, window), " ")), F.lit(blocks)).cast("int"))

    def make(table: pa.Table) -> pa.Table:
        ids: dict[str | None, int] = {}
        rows = [(ids.setdefault(i, len(ids)), i, [w.encode() for w in words]) for i, words in zip(table["item_id"].to_pylist(), table["words"].to_pylist())]
        made = build(sorted(rows), window)
        return pa.table({"block": table["block"].slice(0, 1), "ids": pa.array([list(ids)], pa.list_(pa.string())), "names": [list(made)], "kinds": [[x.dtype.str for x in made.values()]], "arrays": pa.array([[x.tobytes() for x in made.values()]], pa.list_(pa.binary()))})

    schema = "block int, ids array<string>, names array<string>, kinds array<string>, arrays array<binary>"
    return pieces.groupBy("block").applyInArrow(make, schema)


def _worker_matcher(sent, key: str, window: int) -> Matcher:
    ids, arrays = sent.value
    return resident(("suffixes", key), lambda: Matcher({k: np.frombuffer(x, dtype=t) for k, t, x in arrays}, ids, window))


def _passed(df: DataFrame, row, window: int) -> DataFrame:
    """A pass over the documents with one automaton: unites what it finds with what the row has."""
    key = row["key"]
    sent = df.sparkSession.sparkContext.broadcast((list(row["ids"]), [(k, t, bytes(x)) for k, t, x in zip(row["names"], row["kinds"], row["arrays"])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _worker_matcher(sent, key, window)
        for batch in batches:
            at = {name: batch.schema.get_field_index(name) for name in ("text", "n_words", "spans", "items")}
            texts = batch.column(at["text"]).cast(pa.large_binary())
            counts, spans, items = [], batch.column(at["spans"]).to_pylist(), batch.column(at["items"]).to_pylist()
            for i, text in enumerate(texts):
                n, found, owners = matcher.match(text.as_py() or b"")
                counts.append(n)
                if found:
                    spans[i] = united([(s["first"], s["words"], s["longest"]) for s in spans[i]], found)
                    spans[i] = [dict(zip(("first", "words", "longest"), s)) for s in spans[i]]
                    items[i] = sorted({*items[i], *(x for x in map(matcher.ids.__getitem__, owners) if x is not None)})
            columns = list(batch.columns)
            columns[at["n_words"]] = pa.array(counts, pa.int64())
            columns[at["spans"]], columns[at["items"]] = (pa.array(x, batch.schema.field(at[k]).type) for k, x in (("spans", spans), ("items", items)))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return text_batches(df).mapInArrow(run, df.schema)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """docs (with text), n_words, spans, items."""
    made = written(automata(benchmark, window, block_words), "automata")
    blocks = [r["block"] for r in made.select("block").orderBy("block").collect()]
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast(f"array<{SPAN}>").alias("spans"), F.array().cast("array<string>").alias("items")]
    out, before = docs.select(*docs.columns, *none), None
    empty = {"ids": [], "arrays": []}
    for nth, block in enumerate(blocks or [None]):
        if nth and nth % PASSES_AT_ONCE == 0:
            out = written(out, "marked")
            if before is not None:
                discard(before)
            before = out
        if block is None:
            arrays = build([], window)
            row = {**empty, "names": list(arrays), "kinds": [x.dtype.str for x in arrays.values()], "arrays": [x.tobytes() for x in arrays.values()]}
        else:
            row = made.where(F.col("block") == block).first().asDict()  # one block, whose size is bounded
        out = _passed(out, row | {"key": f"{made.written_to}/{block}"}, window)
    discard(made)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit (words within windows), spans (first word, words, longest match) of hit words, items (ids as strings, sorted)."""
    found = _marked(pick(docs, "doc_id", "text"), benchmark, window, block_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without these spans of words; what stood around a span stays."""
    raw = text.encode()
    places = [m.span() for m in _WORDS.finditer(raw.translate(_TABLE))]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : places[s["first"]][0]])
        at = places[s["first"] + s["words"] - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = WINDOW, most_coverage: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without spans of least_words hit words or more; rows of whose words a larger share than most_coverage is hit go."""
    carried = Carried(docs)
    place = carried.place("text")
    found = _marked(carried.rows.select("row_", carried["text"].alias("text")), benchmark, window, block_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    kept = found.where(hit <= F.col("n_words") * F.lit(most_coverage)).select("row_", F.filter("spans", lambda s: s["words"] >= least_words).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, row = batch.column(1), batch.column(0)
            if not any(len(s) for s in spans):
                yield pa.RecordBatch.from_arrays([row], schema=pa.schema([batch.schema.field(0)]))
                continue
            fields = row.flatten()
            texts = [without_spans(t, s) if s else t for t, s in zip(fields[place].to_pylist(), spans.to_pylist())]
            fields[place] = pa.array(texts, fields[place].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], schema=pa.schema([batch.schema.field(0)]))

    return carried.restored(text_batches(kept).mapInArrow(run, carried.rows.schema))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), s AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0
), i AS (
  SELECT DISTINCT item_id, n, array_to_string(w[x:x + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS x FROM s)
), d AS (
  SELECT r, n, x, array_to_string(w[x:x + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS x FROM t CROSS JOIN (SELECT DISTINCT n FROM s) WHERE len(w) >= n)
), f AS (
  SELECT d.r, d.n, d.x, i.item_id FROM d JOIN i ON i.n = d.n AND i.g = d.g
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(x, x + n)) AS p FROM (SELECT DISTINCT r, n, x FROM f)) GROUP BY r
), o AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM f WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(o.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h ON h.r = t.r LEFT JOIN o ON o.r = t.r"""
