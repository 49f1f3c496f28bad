"""Secret scans, by DataFrame functions only: fixed patterns, and character Markov models.

Patterns give the base spans. Beyond them, every run of at least ``min_chars`` characters
``[A-Za-z0-9+/_=-]`` is scored by two first-order Markov models of its characters, one trained on
random strings, the other on ordinary identifiers and words: where the mean log-likelihood ratio of
its transitions exceeds ``threshold``, the run is a span of kind ``markov``. Base spans are cut out
first, and what is left of a run on either side is scored as a run of its own. The models are trained from a table of labelled samples (``sample``, ``random``), by
counting transitions over 63 character classes; they are at most 63 * 63 numbers.

Spans are in code points, end exclusive. Spark has no function for match positions, so they are
summed from the lengths of matches and of the pieces between them; the work grows with a text's length
and its matches, except that a run with many base spans inside is copied once for each.

Defined cases: null text is empty and has no spans; repeated rows are each scanned; an empty table
gives no rows; labelled samples that are null or of fewer than two characters add nothing; without
samples both models are uniform and nothing is added; other columns are not read, or kept as they
are (``redact``).

A very long text is one row of strings and arrays; spans that begin together are listed in the order
of kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.folds import once, walk
from tessera.session import ship_package


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the class is matched whole, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
_SPAN = "struct<start:int,end:int,match:string>"
#: Code points of the blocks that texts are cut from.
BLOCK = 1024
#: Letters by case, digits, and all else as one class.
CLASSES = 63

#: Ordinary words and identifiers' parts, fixed: the ordinary half of the default samples is made of these.
ORDINARY = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three "
    "der die und das nicht ein eine von zu mit sich auf den ist auch werden haben keit heit ung schaft lich isch chen "
    "que de la el en los del las por con para una como mente cion ado ido "
    "le les des et une est dans pour qui sur pas plus tion ment eau aux elle "
    "get set value index name type list map file path user data key node count size config error result request response handler manager service client server buffer stream parse read write open close string number object array function class method"
)


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples made from a rule: hex, base64, base32-like and mixed strings of a hash, against words and compounds joined in the usual ways."""
    words = F.split(F.lit(ORDINARY), " ")
    count = len(ORDINARY.split(" "))
    digest = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n]", "")
    random = (
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 4 == 1, F.substring(base64, 1, 40))
        .when(F.col("id") % 4 == 2, F.upper(F.regexp_replace(base64, "[^A-Za-z2-7]", "")))
        .otherwise(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))
    )
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(count)) + 1).cast("int"))
    plain = (
        F.when(F.col("id") % 6 == 0, F.concat_ws("_", word(1), word(2), word(3)))
        .when(F.col("id") % 6 == 1, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3))))
        .when(F.col("id") % 6 == 2, F.concat_ws("-", word(1), word(2), word(3)))
        .when(F.col("id") % 6 == 3, F.concat_ws("/", word(1), word(2), word(3), word(4)))
        .when(F.col("id") % 6 == 4, F.upper(F.concat_ws("_", word(1), word(2), word(3))))
        .otherwise(F.concat(word(1), word(2), word(3), word(4), word(5)))
    )
    ids = spark.range(n)
    return ids.select(random.alias("sample"), F.lit(True).alias("random")).unionAll(ids.select(plain.alias("sample"), F.lit(False).alias("random")))


def _class_of(char: Column) -> Column:
    """0-25 a-z, 26-51 A-Z, 52-61 0-9, 62 all else, looked up by the character's code."""
    table = [62] * 128
    for base, first, n in ((0, 97, 26), (26, 65, 26), (52, 48, 10)):
        table[first : first + n] = range(base, base + n)
    lookup = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return F.when(F.ascii(char) < 128, F.element_at(lookup, F.ascii(char) + 1)).otherwise(F.lit(62))


def _transitions(text: Column) -> Column:
    """Array of class * CLASSES + next class."""
    classes = F.transform(F.split(text, ""), _class_of)
    return F.zip_with(F.slice(classes, 1, F.greatest(F.size(classes) - 1, F.lit(0))), F.slice(classes, 2, F.greatest(F.size(classes) - 1, F.lit(0))), lambda a, b: a * CLASSES + b)


def train_markov(samples: DataFrame, smoothing: float = 0.3) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every transition: CLASSES ** 2 numbers, whatever the samples' size."""
    used = samples.where(F.col("sample").isNotNull() & F.col("random").isNotNull() & (F.length("sample") > 1))
    counts = used.select(F.col("random").cast("boolean").alias("r"), F.explode(_transitions(F.col("sample"))).alias("t")).groupBy("t").agg(F.count_if("r").alias("a"), F.count_if(~F.col("r")).alias("b")).collect()
    a, b = [smoothing] * CLASSES**2, [smoothing] * CLASSES**2
    for row in counts:
        a[row["t"]] += row["a"]
        b[row["t"]] += row["b"]
    out = []
    for i in range(0, CLASSES**2, CLASSES):
        x, y = sum(a[i : i + CLASSES]), sum(b[i : i + CLASSES])
        out += [math.log(a[j] / x) - math.log(b[j] / y) for j in range(i, i + CLASSES)]
    return out


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (start, end, match), in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("match")))

    def step(at, x):
        start = at + x["gap"]
        return start + x["size"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["match"].alias("match")))

    return walk(pieces, F.lit(0), step, _SPAN)


def _left(runs: Column, base: Column, min_chars: int) -> Column:
    """What base spans leave of runs, where it has min_chars: (start, end, match). base: sorted by start."""
    event = lambda start, kind, end, match: F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("match"))
    far = F.lit((1 << 31) - 1)
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b["start"], 0, b["end"], F.lit(""))), F.transform(runs, lambda r: event(r["start"], 1, r["end"], r["match"])), F.array(event(far, 1, far, F.lit("")))))
    # at: where the part of the run that is still open begins; covered: the farthest end of a base span
    state = lambda at, covered, first, last, run: F.struct(at.alias("at"), covered.alias("covered"), first.alias("first"), last.alias("last"), run.alias("run"))
    zero = F.lit(0)

    def step(s, x):
        n = F.least(x["start"], s["last"]) - s["at"]
        piece = F.struct(s["at"].alias("start"), (s["at"] + n).alias("end"), F.substring(s["run"], s["at"] - s["first"] + 1, n).alias("match"))
        out = F.when(n >= min_chars, F.array(piece)).otherwise(F.array().cast(f"array<{_SPAN}>"))
        covered = F.greatest(s["covered"], x["end"])
        base = state(F.greatest(s["at"], x["end"]), covered, s["first"], s["last"], s["run"])
        return F.when(x["kind"] == 0, base).otherwise(state(F.greatest(x["start"], s["covered"]), s["covered"], x["start"], x["end"], x["match"])), out

    return walk(events, state(zero, zero, zero, zero, F.lit("")), step, _SPAN)


def _where(text: Column, hint: str, spans: Column) -> Column:
    """spans where the text holds the hint, else none: rows without it cost one search."""
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scan(documents: DataFrame, model: list[float], *, min_chars: int = 20, threshold: float = 0.6) -> DataFrame:
    """All columns of documents as a struct ``row``, its ``text``, and ``base`` and ``added`` spans: arrays of (start, kind, end), kind by its place in KINDS."""
    ship_package(documents.sparkSession)
    text = F.col("text")
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    run = r"[A-Za-z0-9+/_=-]{%d,}" % min_chars
    ratio = lambda match: F.aggregate(_transitions(match), F.lit(0.0), lambda acc, t: acc + F.element_at(weights, t + 1)) / (F.length(match) - 1)
    held = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = F.filter(_located(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6)
    found = held.select(
        "row", "text",
        _where(text, r"(?i:password|passwd|secret|token|api_?key)", assign).alias("assign"),
        _where(text, "AKIA", _located(text, ACCESS)).alias("access"),
        _where(text, HEX, _located(text, HEX)).alias("hex"),
        _where(text, run, _located(text, run)).alias("runs"),
    )
    kinds = lambda spans, kind: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    based = found.select("row", "text", F.array_sort(F.concat(*(kinds(F.col(k), n) for n, k in enumerate(KINDS[:3])))).alias("base"), "runs")
    left = F.when(F.size("runs") > 0, _left(F.col("runs"), F.col("base"), min_chars)).otherwise(F.col("runs"))
    return based.select("row", "text", "base", kinds(F.filter(left, lambda m: ratio(m["match"]) > threshold), 3).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, model: list[float], **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for every row."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(documents, model, **options).select(
        F.col("row.doc_id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.size("added").cast("long").alias("n_markov"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(documents: DataFrame, model: list[float], *, mark: str = "[SECRET]", **options) -> DataFrame:
    """documents, all columns, with every span of their text replaced (overlapping spans by one mark) and n_chars, where present, counted anew."""
    after = F.array(F.struct(F.length("text").alias("start"), F.lit(len(KINDS)).alias("kind"), F.length("text").alias("end")))

    def cut(blocks, first, last):
        """Of the text, by the few blocks that hold it."""
        lo = F.floor(first / BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(blocks, lo + 1, F.floor((last - 1) / BLOCK).cast("int") - lo + 1), ""), first - lo * BLOCK + 1, last - first)

    def replaced(blocks):
        def step(at, s):
            gap = F.when(s["start"] > at, cut(blocks, at, s["start"])).otherwise(F.lit(""))
            shown = F.when((s["start"] >= at) & (s["kind"] < len(KINDS)), F.concat(gap, F.lit(mark))).otherwise(gap)
            return F.greatest(at, s["end"]), F.array(shown)

        return F.array_join(walk(F.concat(F.array_sort(F.concat("base", "added")), after), F.lit(0), step, "string"), "")

    walked = once(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), replaced)
    some = F.size("base") + F.size("added") > 0
    found = scan(documents, model, **options).withColumn("clean", F.when(some, walked).otherwise(F.col("row.text")))
    out = {"text": F.col("clean")} | ({"n_chars": F.length("clean").cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return found.select(*(out.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns))
