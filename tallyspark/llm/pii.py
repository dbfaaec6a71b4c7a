"""Personal data by fixed patterns, and by contextual patterns bootstrapped from what those find."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The kind that has no fixed pattern of the base: keys and tokens. Long runs of hexadecimal digits are its seeds.
SECRET = "secret"
ORDER = (*KINDS, SECRET)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits starts: what fails there fails at each of its digits
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")
_SEED = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_EDGE = re.compile(r"[^\W_]")

#: An identifier-like word for discovery: holds an @ or at least this many digits.
CANDIDATE_DIGITS = 4
#: Words of more characters stand in contexts by a digest.
LONG = 40
#: A pattern counts if it has so many distinct instances, and among what fills its slot this share of their score (PRIOR
#: fillings of no score are added). Scores go round until none changes by TOLERANCE, at most ROUNDS times; an instance
#: of ACCEPT is found.
SUPPORT, CONFIDENCE, PRIOR, ACCEPT, TOLERANCE, ROUNDS = 5, 0.8, 1.0, 0.8, 1e-6, 20


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * int(d)) % 10 + (d > "4") for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What finditer of _EMAIL gives: a match starts at the start of the run of local characters before an @."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            found.append(m.span())
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive: leftmost and non-overlapping within the kind, failing matches dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ORDER.index(x[0]), x[1], x[2])))


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _key(word: str) -> str:
    """A word as it stands in a context: lower-cased, digits as 0."""
    word = _DIGIT.sub("0", word.lower())
    return word if len(word) <= LONG else "#" + _digest(word)


def shape_of(token: str) -> str:
    """The kinds of characters of an instance, in a fixed order, and the doublings of its length."""
    kinds = "".join(name for name, test in (("0", str.isdigit), ("a", str.isalpha)) if any(map(test, token)))
    return kinds + "".join(sorted({c for c in token if not c.isalnum()}))[:8] + str(len(token).bit_length())


def _core(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A word without what isn't a letter or digit at its ends."""
    first = _NOT_EDGE.search(text, start, end)
    if first is None:
        return None
    while not text[end - 1].isalnum():
        end -= 1
    return first.start(), end


def _is_candidate(word: str) -> bool:
    if "@" in word:
        return True
    return _DIGIT.search(word) is not None and len(_NOT_DIGITS.sub("", word)) >= CANDIDATE_DIGITS


def occurrences(text: str, spans: list[tuple[str, int, int]]):
    """(kind or None, start, end, contexts) of each base span and each other identifier-like word, in one pass.

    Contexts are the two words before, and the word before with the word after. A word's place in a context is by
    white space; words that a span touches are part of the slot.
    """
    if not spans and "@" not in text and not _DIGIT.search(text):
        return
    known, at = sorted((s, e, k) for k, s, e in spans), 0
    last = before = ("", "")  # the two words before the next word and before the slot, as keys; empty at the start
    waiting: list[tuple] = []

    def contexts(own: tuple[str, str], after: str) -> list[str]:
        return [x for x, good in ((f"2 {own[0]} {own[1]}", own[0] and own[1]), (f"1 {own[1]} _ {after}", own[1] and after)) if good]

    for m in _WORD.finditer(text):
        start, end = m.span()
        found = []
        while at < len(known) and known[at][0] < end:
            found.append((known[at][2], known[at][0], known[at][1]))
            at += 1
        word = m[0]
        if not any(x[2] > start for x in waiting):  # else a span before reaches into this word
            key = _key(word)
            for kind, s, e, own in waiting:
                yield kind, s, e, contexts(own, key)
            waiting, before, last = [], last, (last[1], key)
            if not found and _is_candidate(word) and (core := _core(text, start, end)):
                found.append((SECRET if _SEED.fullmatch(text, *core) else None, *core))
        waiting += [(k, s, e, before) for k, s, e in found]
    for kind, s, e, own in waiting:
        yield kind, s, e, contexts(own, "")


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("shape", pa.string()), ("instance", pa.string()), ("contexts", pa.list_(pa.string()))])
_SCAN = "doc_id long, row long, spans array<struct<kind:string,start:int,end:int>>, seen array<struct<kind:string,start:int,end:int,shape:string,instance:string,contexts:array<string>>>"


def _scan(batches):
    for batch in batches:
        spans, seen = [], []
        for text in batch.column("text").to_pylist():
            base = [(k, s, e) for k, x in base_spans(text).items() for s, e in x]
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            seen.append([{"kind": k, "start": s, "end": e, "shape": shape_of(text[s:e]), "instance": _digest(text[s:e]), "contexts": c} for k, s, e, c in occurrences(text, base) if c])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(spans, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))], ["doc_id", "row", "spans", "seen"])


def slots(texts: DataFrame, contexts: DataFrame, n: int) -> DataFrame:
    """(context, fillings): how often each of contexts (context) occurs in texts (text), whatever fills its slot.

    The contexts are those that enough distinct instances share; they travel to the texts, where they are counted. Were
    they too many for that, the contexts of all words are joined to them instead.
    """
    small = n <= common.BROADCAST_ROWS
    told = texts.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in contexts.collect()) if small else None)

    def run(batches):
        wanted = told.value
        firsts = None if wanted is None else {x.split(" ")[1] for x in wanted}
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                low = _DIGIT.sub("0", text.lower())
                if firsts is not None and len(firsts) < 8 and not any(x in low or x[0] == "#" for x in firsts):
                    continue
                words = [w if len(w) <= LONG else _key(w) for w in _WORD.findall(low)]
                for i, word in enumerate(words):
                    if firsts is not None and word not in firsts:
                        continue
                    if i + 2 < len(words):
                        for context in (f"2 {word} {words[i + 1]}", f"1 {word} _ {words[i + 2]}"):
                            if wanted is None or context in wanted:
                                counts[context] += 1
                if len(counts) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["context", "n"])
                    counts = Counter()
            yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["context", "n"])

    found = texts.mapInArrow(common.task("pii", run), "context string, n long").groupBy("context").agg(F.sum("n").alias("fillings"))
    return found if small else found.join(contexts, "context")


def score_patterns(seen: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, context, shape, confidence) of the patterns that count: a context and the shape of what fills its slot, * for any.

    seen has occurrences (kind or null, shape, instance, contexts), texts all texts (text). Seeds of a kind score 1 for
    it. Each round a pattern's confidence is its distinct instances' score, over the instances, the fillings of its
    context that aren't like identifiers (counted over all texts) and PRIOR; another instance's score is that of its
    best pattern. Rounds end when no confidence changes.
    """
    edges = seen.select("kind", F.explode(F.array(F.col("shape"), F.lit("*"))).alias("shape"), "instance", "contexts").select("kind", "shape", "instance", F.explode("contexts").alias("context"))
    edges = common.cut(edges.groupBy("context", "shape", "instance").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("uses")), "edges")
    nothing = edges.select("kind", "context", "shape", F.lit(0.0).alias("confidence")).limit(0)
    total = edges.groupBy("context", "shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    pairs = edges.where("kind is not null").select("kind", "context", "shape").distinct().join(total, ["context", "shape"])
    pairs = common.cut(pairs, "pairs")
    contexts = common.cut(pairs.select("context").distinct(), "contexts")
    n = contexts.count()
    if not n:
        return nothing
    used = edges.where("shape = '*'").join(common.maybe_broadcast(contexts, n), "context").groupBy("context").agg(F.sum("uses").alias("uses"))
    ordinary = used.join(common.cut(slots(texts, contexts, n), "slots"), "context", "left").select("context", F.greatest(F.coalesce("fillings", "uses") - F.col("uses"), F.lit(0)).alias("ordinary"))
    pairs = common.cut(pairs.join(ordinary, "context"), "pairs")
    live = common.cut(edges.join(pairs.select("context", "shape").distinct(), ["context", "shape"]).select("context", "shape", "instance"), "live")
    seeds = common.cut(edges.where("kind is not null").select("instance", "kind").distinct(), "seeds")
    scores, patterns = seeds.withColumn("score", F.lit(1.0)), None
    others = live.join(seeds.select("instance").distinct(), "instance", "left_anti")
    for _ in range(rounds):
        trusted = live.join(scores, "instance").groupBy("context", "shape", "kind").agg(F.sum("score").alias("score"))
        now = pairs.join(trusted, ["context", "shape", "kind"]).select("kind", "context", "shape", (F.col("score") / (F.col("n") + F.col("ordinary") + PRIOR)).alias("confidence"))
        now = common.cut(now, "patterns")
        if patterns is not None:
            moved = now.join(patterns.withColumnRenamed("confidence", "was"), ["kind", "context", "shape"]).where(F.abs(F.col("confidence") - F.col("was")) > TOLERANCE)
            if not moved.limit(1).count():
                break
        patterns = now
        reached = others.join(patterns.where(F.col("confidence") >= CONFIDENCE), ["context", "shape"]).groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        scores = seeds.withColumn("score", F.lit(1.0)).unionByName(reached.select("instance", "kind", "score"))
    return now.where(F.col("confidence") >= CONFIDENCE)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, spans, more): the spans of the fixed patterns and those that contexts add, a row per row of docs.

    row numbers the rows of docs as read; it tells repeated ids apart. Null texts are empty and have no spans; null ids
    keep their row. An added span never overlaps one of the fixed patterns, and has the kind of its best pattern.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), common.text_of(text_col).alias("text"))
    scanned = common.cut(rows.mapInArrow(common.task("pii", _scan), _SCAN), "scanned")
    seen = scanned.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    patterns = common.cut(score_patterns(seen, rows.select("text")), "kept")
    n = patterns.count()
    if not n:
        return scanned.select("doc_id", "row", "spans", F.slice("spans", 1, 0).alias("more"))
    loose = seen.where(F.col("kind").isNull() | (F.col("kind") == SECRET)).drop("kind").withColumn("context", F.explode("contexts")).withColumn("shape", F.explode(F.array("shape", F.lit("*"))))
    loose = loose.join(common.maybe_broadcast(patterns, n), ["context", "shape"]).where(F.col("confidence") >= ACCEPT)
    best = loose.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    added = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    return scanned.join(added, "row", "left").select("doc_id", "row", "spans", F.coalesce("more", F.slice("spans", 1, 0)).alias("more"))


def _digests(batches):
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        hashes, everything, sums = [], [], []
        for spans, more in zip(batch.column("spans").to_pylist(), batch.column("more").to_pylist(), strict=True):
            own = [(x["kind"], x["start"], x["end"]) for x in spans]
            for k in KINDS:
                counts[k].append(sum(x[0] == k for x in own))
            hashes.append(hashlib.sha256(joined(own).encode()).hexdigest())
            everything.append(joined(own + [(x["kind"], x["start"], x["end"]) for x in more]))
            sums.append(len(own) + len(more))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes), pa.array(everything), pa.array(sums, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans): counts and hash of the fixed patterns' spans,
    all spans (those of kind secret last), and their number."""
    return find(docs, id_col, text_col).mapInArrow(_digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of spans that overlap the first, then longest, counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with personal data in the text replaced by its kind; other columns, null texts and rows stay as they are.

    The fixed patterns are applied where the text is, so texts aren't shuffled; discovered patterns travel to it.
    """
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), common.text_of(text_col).alias("text"))
    seen = common.cut(rows.mapInArrow(common.task("pii", _scan), _SCAN).select(F.explode("seen").alias("x")).select("x.kind", "x.shape", "x.instance", "x.contexts"), "seen")
    patterns = common.cut(score_patterns(seen, rows.select("text")), "kept")
    n = patterns.count()
    told = None
    if n and n <= common.BROADCAST_ROWS:
        best: dict[tuple[str, str], tuple[float, str]] = {}
        for r in patterns.where(F.col("confidence") >= ACCEPT).collect():
            place = (r["context"], r["shape"])
            best[place] = max(best.get(place, (0.0, "")), (r["confidence"], r["kind"]))
        told = docs.sparkSession.sparkContext.broadcast(best)
    elif n:
        return _redacted_by_join(docs, text_col, id_col)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        own = [(k, s, e) for k, x in base_spans(text).items() for s, e in x]
        if told:
            for kind, s, e, contexts in list(occurrences(text, own)):
                if kind is None or kind == SECRET:
                    shape = shape_of(text[s:e])
                    found = [told.value[x] for c in contexts for x in ((c, shape), (c, "*")) if x in told.value]
                    if found:
                        own.append((max(found)[1], s, e))
        return redact(text, own) if own else text

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from common.task("pii", lambda parts: (x.map(one) for x in parts))(batches)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def _redacted_by_join(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Where too many patterns were found to broadcast: spans are joined to their texts by row."""
    numbered = common.cut(docs.withColumn("row__", F.monotonically_increasing_id()), "numbered")
    spans = common.cut(find(numbered.drop(id_col).withColumnRenamed("row__", id_col), id_col, text_col), "spans")
    spans = spans.select(F.col("doc_id").alias("row__"), F.concat("spans", "more").alias("all__")).where(F.size("all__") > 0)

    @F.pandas_udf("string")
    def clean(texts, found):
        return pd.Series([t if t is None or s is None else redact(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(texts, found, strict=True)])

    return numbered.join(spans, "row__", "left").withColumn(text_col, clean(F.col(text_col), F.col("all__"))).select(*docs.columns)
