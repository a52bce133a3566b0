"""Personal data in texts: fixed patterns as seeds, and contexts bootstrapped from them.

Base spans come from four patterns and their checks. Each is a seed of its kind.
The words around seeds are lexical patterns: two words before, one before with one
after, two after, and the last label (a word that ends in a colon, equals or number
sign). Other tokens and number groups that hold digits or an at sign are instances
that may turn out to be identifiers. Patterns and instances form a graph. A
pattern's score for a kind is the share of that kind's instances among those known to be
of some kind or of none; instances not known weigh ``UNKNOWN`` each, and seeds that a
checksum lets pass by chance are taken off. An instance's score is the noisy-or of
its confident patterns, at least two of them or a very confident one, for the kinds its form allows.
Both are computed in turn. Instances that end up above the threshold are found
wherever they occur. All of it is DataFrame operations; only spans and contexts
leave the scan, never texts.

The patterns are written so that a match can only start where one may start and
never backtracks: long runs of digits or letters are read once. Matches and the
gaps between them are rows' columns before positions are summed up, so that no
expression over a whole text stands inside a function over its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace

KINDS = ("email", "ip", "card", "phone")
#: Equal in what they match to the kinds' plain patterns; card only takes runs of 14 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Candidates: numbers in groups with single spaces between, or one token with a digit or an at sign.
TOKEN = r"(?<!\S)(?:[(+]*+[0-9][0-9().+/-]*+(?:\x20[(]?[0-9][0-9().+/-]*+)++(?!\S*+[A-Za-z@])|[^\s0-9@]*+[0-9@]\S*+)"
#: Characters of context on either side, rounds of scoring, the seeds a pattern needs, its least score, and an instance's.
CONTEXT, ROUNDS, SUPPORT, CONFIDENT, ACCEPT = 80, 3, 4, 0.5, 0.8
#: The score of a pattern that is enough by itself.
ALONE = 0.9
#: Weight of an instance not known to be of any kind, the prior's weight, and the longest candidate in code points.
UNKNOWN, SMOOTHING, LONGEST = 0.2, 1.0, 64
#: How often a random candidate of the kind's form passes its check.
CHANCE = {"card": 0.1}
CHUNK, PART = 512, 128
SPAN = "array<struct<start:int,rank:int,end:int,hit:string,before:string,after:string>>"
_KEYS = ("doc_id", "th")


def _materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row: a generator keeps them from being inlined where they are used."""
    names = df.columns
    held = df.select(*names, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_held"))
    return held.select(*names, *[F.col(f"_held.{n}").alias(n) for n in columns])


def _spans(gaps: Column, hits: Column, rank: int) -> Column:
    """All matches with start and end in code points and the text around them, from columns of gaps and matches.

    Offsets are summed over chunks, then within each: appending to one array of all matches would be quadratic.
    """
    size = lambda i: F.length(F.get(gaps, i)) + F.length(F.get(hits, i))
    n = F.coalesce(F.size(hits), F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, n) - 1))
    ahead = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, c: F.struct(
        F.aggregate(c, a["at"], lambda s, i: s + size(i)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    def placed(chunk: Column, offset: Column) -> Column:
        start = F.struct(offset.cast("int").alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(gaps, i))
            e = s + F.length(F.get(hits, i))
            span = F.struct(s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.get(hits, i).alias("hit"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(chunk, start, step, lambda acc: acc["out"])

    return F.when(n > 0, F.flatten(F.zip_with(chunks, ahead, placed))).otherwise(F.array().cast(SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    value = lambda i: F.ascii(F.substring(digits, i, F.lit(1))) - 48
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, double(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _possible(hit: Column) -> list[Column]:
    """Whether a candidate's form allows each kind."""
    digits, odd = F.length(_digits(hit)), hit.rlike(r"[^0-9\x20().+/-]")
    return [F.contains(hit, F.lit("@")), hit.rlike(r"^[0-9]+([.,][0-9]+){3}$"), ~odd & digits.between(12, 19), ~odd & digits.between(7, 15)]


def _checked(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _of(rank: int):
    return lambda s: s["rank"] == rank


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, base, found)``: valid matches by start and kind, and candidates, of each row; th is a hash of its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    patterns = [*PATTERNS.values(), TOKEN]
    gates = [F.contains(text, F.lit(g)) if g else F.lit(True) for g in GATES.values()] + [text.rlike("[0-9@]")]
    hits = {f"hits{k}": F.when(g, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, (p, g) in enumerate(zip(patterns, gates))}
    rows = _materialised(rows, **hits)
    rows = _materialised(rows, **{f"gaps{k}": F.when(F.size(f"hits{k}") > 0, F.split(text, p, -1)) for k, p in enumerate(patterns)})
    base = [F.filter(_spans(F.col(f"gaps{k}"), F.col(f"hits{k}"), k), _checked(kind)) for k, kind in enumerate(KINDS)]
    last = len(KINDS)
    core = lambda s: F.regexp_replace(s["hit"], r"[.,;:!?)\]}\"'>]+$|^[(\[{\"'<]+(?![0-9]+\))", "")
    lead = lambda s: F.length(F.regexp_extract(s["hit"], r"^[(\[{\"'<]+(?![0-9]+\))", 0))
    cores = F.transform(_spans(F.col(f"gaps{last}"), F.col(f"hits{last}"), -1), lambda s: F.struct((s["start"] + lead(s)).alias("start"), s["rank"].alias("rank"), (s["start"] + lead(s) + F.length(core(s))).alias("end"), core(s).alias("hit"), s["before"].alias("before"), s["after"].alias("after")))
    likely = lambda s: F.length(s["hit"]).between(4, LONGEST) & ((F.length(_digits(s["hit"])) >= 3) | F.contains(s["hit"], F.lit("@")))
    return rows.select(*_KEYS, F.array_sort(F.concat(*base)).alias("base"), F.filter(cores, likely).alias("found"))


def _contexts(before: Column, after: Column) -> Column:
    """Lexical patterns around a span, in lower case with digits made alike."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[0-9]+", "0")
    left, right = F.split(plain(before), r"\s+"), F.split(plain(after), r"\s+")
    at = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
    near = F.filter(F.slice(F.reverse(left), F.lit(1), F.lit(3)), lambda w: w.rlike("[:=#]$"))
    label = F.when(F.size(near) > 0, F.concat(F.lit("# "), F.get(near, F.lit(0))))
    patterns = F.array(F.concat_ws(" ", F.lit("<"), at(left, -2), at(left, -1)), F.concat_ws(" ", F.lit("|"), at(left, -1), F.lit("_"), at(right, 1)), F.concat_ws(" ", F.lit(">"), at(right, 1), at(right, 2)), label)
    return F.array_compact(patterns)


def _occurrences(scanned: DataFrame) -> DataFrame:
    """``(doc_id, th, start, end, rank, hit, before, after)``: base spans, and the candidates that touch none of them (rank -1)."""
    one = scanned.select(*_KEYS, F.explode(F.concat("base", "found")).alias("s")).select(*_KEYS, "s.*")
    seed = F.col("rank") >= 0
    up = Window.partitionBy(*_KEYS).orderBy("start", F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*_KEYS).orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    told = one.withColumn("_ends", F.max(F.when(seed, F.col("end"))).over(up)).withColumn("_starts", F.min(F.when(seed, F.col("start"))).over(down))
    free = (F.coalesce("_ends", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_starts") >= F.col("end"), F.lit(True)))
    return told.where(seed | free).drop("_ends", "_starts")


def discover(ws: Workspace, scanned: DataFrame) -> DataFrame:
    """``(doc_id, th, start, end, rank)``: spans of discovered identifiers."""
    kinds = range(len(KINDS))
    spans = ws.table(_occurrences(scanned).withColumn("instance", F.lower("hit")))
    edges = ws.table(spans.select("instance", "rank", F.explode(_contexts(F.col("before"), F.col("after"))).alias("pattern")).distinct())
    # an instance that is a seed anywhere keeps that kind; s: how far it is of a kind, o: whether its form allows that
    first = edges.groupBy("instance").agg(F.max("rank").alias("seed"))
    scores = ws.table(first.select("instance", "seed", *[F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(f"s{k}") for k in kinds], *[p.alias(f"o{k}") for k, p in enumerate(_possible(F.col("instance")))]))
    pairs = ws.table(edges.select("instance", "pattern").distinct())
    for _ in range(ROUNDS):
        seeded, sure = F.col("seed") >= 0, F.greatest(*[F.col(f"s{k}") for k in kinds])
        sums = []
        for k in kinds:
            unknown = ~seeded & F.col(f"o{k}")
            sums += [
                F.sum(f"s{k}").alias(f"w{k}"),
                F.sum(F.when(F.col("seed") == k, 1).otherwise(0)).alias(f"k{k}"),
                F.sum(F.when(unknown, 1 - sure).otherwise(0.0)).alias(f"u{k}"),
                F.sum(F.when(unknown, 0.0).otherwise(1 - F.col(f"s{k}"))).alias(f"n{k}"),
            ]
        pattern = pairs.join(scores, "instance").groupBy("pattern").agg(*sums)
        share = []
        for k, kind in enumerate(KINDS):
            c = CHANCE.get(kind, 0.0)
            good = F.greatest(F.lit(0.0), F.col(f"w{k}") - F.col(f"u{k}") * c / (1 - c))
            share.append(F.when(F.col(f"k{k}") >= SUPPORT, good / (F.col(f"w{k}") + F.col(f"n{k}") + UNKNOWN * F.col(f"u{k}") + SMOOTHING)).otherwise(0.0))
        good = pattern.select("pattern", *[F.when(p >= CONFIDENT, p).otherwise(0.0).alias(f"p{k}") for k, p in enumerate(share)]).where(" or ".join(f"p{k} > 0" for k in kinds))
        several = lambda k: (F.sum(F.when(F.col(f"p{k}") > 0, 1).otherwise(0)) >= 2) | (F.max(f"p{k}") >= ALONE)
        inferred = pairs.join(good, "pattern").groupBy("instance").agg(*[F.when(several(k), 1 - F.exp(F.sum(F.log1p(-F.least(F.col(f"p{k}"), F.lit(0.999)))))).otherwise(0.0).alias(f"i{k}") for k in kinds])
        update = [F.when(F.col("seed") >= 0, F.col(f"s{k}")).when(F.col(f"o{k}"), F.coalesce(F.col(f"i{k}"), F.lit(0.0))).otherwise(0.0).alias(f"s{k}") for k in kinds]
        new = ws.table(scores.join(inferred, "instance", "left").select("instance", "seed", *update, *[f"o{k}" for k in kinds]))
        ws.drop(scores, sweep=False)
        scores = new
    best = F.array_max(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("k")) for k in kinds]))
    accepted = scores.select("instance", best.alias("best")).where(F.col("best.score") >= ACCEPT).select("instance", (-F.col("best.k")).alias("kind"))
    places = spans.where("rank < 0").select(*_KEYS, "start", "end", "instance")
    return places.join(accepted, "instance").select(*_KEYS, "start", "end", F.col("kind").alias("rank")).distinct()


def _told(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def _slim(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def _same(a: str, b: str) -> Column:
    return (F.col(f"{a}.th") == F.col(f"{b}.th")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` for each row of ``docs(doc_id, text, ...)``; spans are (start, rank, end).

    Null and empty texts have no spans, an empty table no rows. Repeated rows are each
    answered; other columns are ignored, whatever their names. rank is the kind's place in
    ``KINDS``; spans holds the base ones and the discovered ones, by start and then kind.
    """
    ws = Workspace(docs.sparkSession, "pii")
    scanned = ws.table(scan(docs))
    more = discover(ws, scanned).groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    s = scanned.select(*_KEYS, _slim(F.col("base")).alias("base")).alias("s")
    joined = s.join(more.alias("m"), _same("s", "m"), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.array_union("base", "more")))
    return joined.select("s.doc_id", "base", spans.alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; spans that overlap become one, of the first's kind.

    Null and empty texts stay as they are, as do all other columns; repeated rows are each
    answered, and an empty table stays empty.
    """
    ws = Workspace(docs.sparkSession, "redact")
    scanned = ws.table(scan(docs))
    base = scanned.select(*_KEYS, F.explode(_slim(F.col("base"))).alias("s")).select(*_KEYS, "s.start", "s.end", "s.rank")
    before = Window.partitionBy(*_KEYS).orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*_KEYS).orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = base.union(discover(ws, scanned)).distinct().withColumn("_ends", F.max("end").over(before))
    islands = spans.withColumn("island", F.sum(F.when(F.col("start") < F.col("_ends"), 0).otherwise(1)).over(upto)).groupBy(*_KEYS, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "rank", "end")).alias("one"))
    marked = ws.table(islands.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("one.rank").alias("rank")))).alias("_spans"))).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "_spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("_text"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"))
    both = rows.join(marked, (F.col("t") == F.col("_t")) & F.col("d").eqNullSafe(F.col("_d")), "left")
    text, marks, n = F.col("_text"), F.col("_spans"), F.size("_spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def part(g: Column) -> Column:
        """The text up to the end of the g-th spans, from the end of those before: one substring of the text, and small ones of that."""
        some = F.slice(marks, g * PART + 1, F.lit(PART))
        begin = F.when(g == 0, F.lit(0)).otherwise(F.get(marks, g * PART - 1)["end"])
        end = F.get(marks, F.least((g + 1) * PART, n) - 1)["end"]
        piece = F.array(F.struct(begin.alias("from"), F.substring(text, begin + 1, end - begin).alias("text")))
        told = F.transform(piece, lambda p: F.aggregate(some, F.struct(p["from"].alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(p["text"], a["at"] - p["from"] + 1, s["start"] - a["at"]), F.get(names, s["rank"])).alias("out")), lambda a: a["out"]))
        return F.get(told, F.lit(0))

    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PART).cast("int")), part)
    rest = F.substring(text, F.get(marks, n - 1)["end"] + 1, F.length(text))
    new = F.when(marks.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))
    return both.select(*[new.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    got = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return got.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), added)
