"""Secret scan: patterns of known forms, and character Markov models for strings of none.

Two first-order models of characters, one of random strings and one of ordinary identifiers, are
fitted on labelled samples. Random are what the patterns find in the corpus and generated keys;
ordinary are runs of key characters that recur in several documents, and identifiers, paths, dates
and the like made of their words and of a list. Counts cover all documents. A run that no pattern
has found is a secret if its log-likelihood ratio per character reaches a threshold, calibrated on
samples that were held out of the training. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored

#: Kinds in the order of ties: (name, pattern, group whose length counts, least length).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A text without any of these holds no match, in small letters for the first kind; such texts skip the pattern.
NEEDED = (("password", "passwd", "secret", "token", "api_key", "apikey"), ("AKIA",), ())
#: Kind of the method's own spans.
ADDED = "random"
#: Runs of these characters are judged; the models know only them.
LETTERS = "A-Za-z0-9+/_=-"
LEAST_RUN = 12
KNOWN = 66
#: Codes are ASCII; 0 stands before a string.
CODES = 128
#: Documents that an ordinary run of the corpus must be found in.
RECUR = 3
#: Share of held-out random samples that may fall below the threshold, and of ordinary ones at or above it.
MISSED, FALSE = 0.02, 0.001
#: Matches whose places are added up in one list.
CHUNK = 128
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"

#: Labelled sample: words that ordinary identifiers, paths and slugs are made of, whatever the corpus.
WORDS = (
    "access account action address admin analysis api archive array article base batch body border buffer cache call center channel class client close code color column command compare config "
    "connect content context control copy count create current data database date default delete description design directory document download edit email enable end entry error event example "
    "exception factory field file filter first font form function get global graph group handler hash health help home host html http image index input interface item java json kernel key label "
    "language last layout length level library light limit link list local lock login mail main manager map memory message method model move name network next node number object offset option "
    "order output page parent parse path pattern payment photo player plugin policy product profile project property proxy public query queue random range record remote report request resource "
    "response result schedule search section server service session setting source standard stream string success support switch system template thread transfer update upload user utility value "
    "vector version video warning web window workspace yield zone"
).split()


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Structs (start, kind, end, value) of all matches, in code points.

    Starts are running sums over what lies between the matches and the matches themselves: first within
    chunks of CHUNK matches, then over the chunks, as a list is copied for each one that is added to it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        first = acc["at"] + s["gap"]
        one = F.struct(first.alias("start"), F.lit(kind).alias("kind"), (first + s["n"]).alias("end"), s["m"].alias("value"))
        return F.struct((first + s["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def after(acc: Column, chunk: Column) -> Column:
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def moved(chunk: Column, by: Column) -> Column:
        return F.transform(chunk["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    def joined(chunks: Column) -> Column:
        first = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), after, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, first, moved))

    def placed(steps: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(steps), F.lit(CHUNK))
        chunked = F.transform(firsts, lambda i: F.aggregate(F.slice(steps, i, F.lit(CHUNK)), start, step))
        many = F.get(F.transform(F.array(chunked), joined), F.lit(0))
        return F.when(F.size(steps) > CHUNK, many).otherwise(F.aggregate(steps, start, step, lambda acc: acc["out"]))

    # a lambda sees a list as a value, not as the expression that makes it
    return F.get(F.transform(F.array(steps), placed), F.lit(0))


def _at_least(n: int):
    return lambda s: F.length(s["value"]) >= n


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _none() -> Column:
    return F.array().cast(SPAN)


def with_base(docs: DataFrame, name: str = "base") -> DataFrame:
    """Adds the pattern spans that are long enough, by start and kind; none for null texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for kind, ((_, pattern, group, least), needed) in enumerate(zip(BASE, NEEDED, strict=True)):
        spans = _spans(text, pattern, kind)
        if group:
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
            spans = F.zip_with(
                spans, values, lambda s, v: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), v.alias("value"))
            )
        holds = text.rlike(pattern)
        for n, word in enumerate(needed):
            has = F.contains(F.lower(text) if group else text, F.lit(word))
            any_ = has if n == 0 else any_ | has
        if needed:
            holds = any_ & holds
        parts.append(F.when(holds, F.filter(spans, _at_least(least))).otherwise(_none()))
    return docs.withColumn(name, F.array_sort(F.concat(*parts)))


def _outside(runs: Column, base: Column) -> Column:
    """What of the runs lies outside all pattern spans, in parts of LEAST_RUN characters or more."""

    def parts(r: Column) -> Column:
        near = F.filter(base, lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"]))
        starts = F.array_distinct(F.concat(F.array(r["start"]), F.transform(near, lambda b: b["end"])))
        free = F.filter(starts, lambda p: (p < r["end"]) & ~F.exists(near, lambda b: (b["start"] <= p) & (p < b["end"])))

        def part(p: Column) -> Column:
            end = F.least(r["end"], F.array_min(F.transform(F.filter(near, lambda b: b["start"] >= p), lambda b: b["start"])))
            return F.struct(p.alias("start"), r["kind"].alias("kind"), end.alias("end"), F.substring(r["value"], p - r["start"] + 1, end - p).alias("value"))

        return F.transform(free, part)

    return F.filter(F.flatten(F.transform(runs, parts)), _at_least(LEAST_RUN))


def with_runs(docs: DataFrame, base: str = "base", name: str = "runs") -> DataFrame:
    """Adds the runs of LEAST_RUN key characters or more that the models judge: all that is outside the pattern spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pattern = f"[{LETTERS}]{{{LEAST_RUN},}}"
    runs = F.when(text.rlike(pattern), _spans(text, pattern, len(BASE))).otherwise(_none())
    return docs.withColumn(name, runs).withColumn(name, F.when((F.size(name) > 0) & (F.size(base) > 0), _outside(F.col(name), F.col(base))).otherwise(F.col(name)))


def _cells(word: Column) -> Column:
    """Index of each pair of neighbouring characters, the first with code 0 before it."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, F.lit(1), F.size(codes) - 1)), codes, lambda a, b: a * CODES + b)


def _number(digits: int, *of: Column) -> Column:
    """That many digits, by the hash of the columns."""
    return F.lpad(F.pmod(F.xxhash64(*of), F.lit(10**digits)).cast("string"), digits, "0")


def identifiers(words: DataFrame, rounds: str = "rounds") -> DataFrame:
    """(word): ordinary strings made of ``words`` (word and the number of rounds), each word in every form once a round.

    Which words meet is told by their hashes, so the same words always give the same strings.
    """
    each = words.select("word", F.explode(F.sequence(F.lit(1), F.col(rounds))).alias("r"))
    order = Window.partitionBy("r", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.xxhash64("word", "r"), "word")
    next_ = lambda n: F.coalesce(F.lead("word", n).over(order), F.col("word"))
    w = each.select("r", F.lower("word").alias("a"), F.lower(next_(1)).alias("b"), F.lower(next_(2)).alias("c"), F.lower(next_(3)).alias("d"))
    a, b, c, d, key = F.col("a"), F.col("b"), F.col("c"), F.col("d"), (F.col("a"), F.col("r"))
    n1, n2, n3, n4 = (_number(n, F.lit(n), *key) for n in (1, 2, 3, 4))
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64(F.lit("day"), *key), F.lit(15_000)).cast("int"))
    digest = F.sha2(F.concat_ws(" ", *key), 256)
    cut = lambda at, n: F.substring(digest, at, n)
    forms = (
        F.concat(a, F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c), n1), F.concat(a, F.initcap(b), n3, F.initcap(c)),
        F.concat_ws("_", a, b, c), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", a, b, c, d), F.concat(a, b, c), F.concat(a, n4, b), F.concat(a, F.lit("="), b, F.lit("_"), n2),
        F.concat(F.date_format(day, "yyyy/MM/"), F.concat_ws("-", a, b, c)), F.concat(F.lit("/"), F.concat_ws("/", a, b, c)), F.concat(F.lit("/"), a, F.lit("/"), b, n1, F.lit("/"), c, F.lit("-"), d),
        F.concat(day.cast("string"), F.lit("T"), F.concat_ws("-", n2, _number(2, c), _number(2, d))), F.concat_ws("-", day.cast("string"), a), F.concat(n4, _number(4, b), _number(6, c)),
        F.concat_ws("-", a, n1, n2, n3), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)),
        F.concat(F.repeat(F.substring(F.lit("=-_x0a+/"), F.pmod(F.xxhash64(F.lit("rep"), *key), F.lit(8)).cast("int") + 1, F.lit(1)), F.pmod(F.xxhash64(F.lit("times"), *key), F.lit(20)).cast("int") + 12), n1),
    )
    return w.select(F.explode(F.array(*forms)).alias("word"))


def keys(spark, generated: int = 2000) -> DataFrame:
    """(word): that many random strings of each form, of 12 to 43 characters, always the same ones."""
    raw = F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    n = F.pmod(F.xxhash64("id"), F.lit(32)).cast("int") + 12
    plain = F.translate(raw, "+/=", "q7")
    prefix = F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64(F.lit("prefix"), "id"), F.lit(len(WORDS))).cast("int") + 1)
    forms = (raw, F.translate(raw, "+/=", "-_"), plain, F.lower(plain), F.upper(plain), F.upper(F.sha2(F.concat(F.lit("h"), "id"), 256)), F.translate(plain, "0123456789", "qWmKzRtXbV"))
    cut = [F.substring(f, F.lit(1), n) for f in forms]
    return spark.range(generated, numPartitions=1).select(F.explode(F.array(*cut, F.concat(prefix, F.lit("_"), F.substring(plain, F.lit(1), n)))).alias("word"))


def samples(found: DataFrame, base: str = "base", runs: str = "runs", generated: int = 2000) -> DataFrame:
    """(word, random): distinct labelled samples of every document (``found`` has its pattern spans and runs) and made ones.

    Random are the pattern spans and generated keys. Ordinary are the runs that RECUR documents without
    pattern spans hold or more, and identifiers of their words and of WORDS.
    """
    spark = found.sparkSession
    spotted = found.select(F.explode(F.col(base)["value"]).alias("word")).distinct()
    plain = found.filter(F.size(base) == 0).select(F.explode(F.array_distinct(F.col(runs)["value"])).alias("word"))
    recurring = stored(plain.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= RECUR).select("word"), "ordinary-runs")
    parts = recurring.select(F.explode(F.regexp_extract_all("word", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("word")).distinct()
    listed = spark.createDataFrame([(w,) for w in WORDS], "word string")
    made = identifiers(parts.withColumn("rounds", F.lit(1)).unionByName(listed.withColumn("rounds", F.lit(10))))
    label = lambda df, kind: df.select("word", F.lit(kind).alias("random"))
    return label(spotted.union(keys(spark, generated)), True).union(label(recurring.union(made), False))


def train(labelled: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """One row: ``model``, the log ratio random / ordinary of each pair of codes.

    ``labelled`` has word and random (boolean). Counts are combined before the shuffle into at most
    2 * CODES**2 rows a task.
    """
    words = labelled.select("random", _known("word").alias("word")).filter("word != ''")
    counts = words.select("random", F.explode(_cells(F.col("word"))).alias("cell")).groupBy("random", "cell").agg(F.count("*").alias("n"))
    grid = labelled.sparkSession.range(2 * CODES**2, numPartitions=2).select((F.col("id") >= CODES**2).alias("random"), (F.col("id") % CODES**2).cast("int").alias("cell"))
    full = grid.join(counts, ["random", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pairs = full.withColumns({"a": F.floor(F.col("cell") / CODES), "b": F.col("cell") % CODES})
    before = pairs.groupBy("random", "a").agg(F.sum("n").alias("n_a"), F.count_if(F.col("n") > 0).alias("t_a"))
    single = pairs.groupBy("random", "b").agg(F.sum("n").alias("n_b"))
    total = pairs.groupBy("random").agg(F.sum("n").alias("n_all"))
    joined = pairs.join(before, ["random", "a"]).join(single, ["random", "b"]).join(total, "random")
    # Witten-Bell: what follows a rare character, or one with many successors, is judged by itself
    alone = (F.col("n_b") + smoothing) / (F.col("n_all") + smoothing * KNOWN)
    p = F.log((F.col("n") + (F.col("t_a") + 1) * alone) / (F.col("n_a") + F.col("t_a") + 1))
    ratio = joined.groupBy("cell").agg(F.sum(F.when(F.col("random"), p).otherwise(-p)).alias("l"))
    return ratio.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", F.round("l", 9).alias("l")))), lambda x: x["l"]).alias("model"))


def _known(word: str) -> Column:
    return F.regexp_replace(word, f"[^{LETTERS}]", "")


def log_ratio(word: Column, model: Column) -> Column:
    return F.aggregate(_cells(word), F.lit(0.0), lambda acc, i: acc + F.get(model, i))


def ratio(word: Column, model: Column) -> Column:
    """Log-likelihood ratio per character; positive: as random strings are."""
    return log_ratio(word, model) / F.length(word)


def calibrate(labelled: DataFrame, model: DataFrame, bins: int = 2000, width: float = 0.01) -> DataFrame:
    """One row: ``threshold``, the highest that MISSED of the random samples at most fall below; higher yet if else more
    than FALSE of the ordinary ones reach it. Without samples it is 0.

    Works on a histogram of a fixed number of bins, so nothing here grows with the input.
    """
    words = labelled.select("random", _known("word").alias("word")).filter("word != ''").withColumn("__model", model.scalar())
    half = bins // 2
    at = F.least(F.greatest(F.floor(ratio(F.col("word"), F.col("__model")) / width), F.lit(-half)), F.lit(half - 1)).cast("int")
    h = words.groupBy(at.alias("bin")).agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    below, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    h = h.select("bin", (before("r") <= MISSED * F.sum("r").over(all_)).alias("found"), (F.sum("o").over(all_) - before("o") <= FALSE * F.sum("o").over(all_)).alias("quiet"))
    lowest, highest = F.min(F.when(F.col("quiet"), F.col("bin"))), F.max(F.when(F.col("found"), F.col("bin")))
    return h.agg(F.coalesce(F.greatest(F.coalesce(lowest, F.max("bin") + 1), highest) * F.lit(width), F.lit(0.0)).alias("threshold"))


def fit(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model and threshold, one row each: three quarters of the samples, by hash, train, and the rest calibrate."""
    held = F.pmod(F.xxhash64(F.lit("held out"), "word"), F.lit(4)) == 0
    labelled = stored(labelled, "secret-samples")
    model = stored(train(labelled.filter(~held)), "secret-model")
    return model, stored(calibrate(labelled.filter(held), model), "secret-threshold")


def scan(docs: DataFrame, labelled: DataFrame | None = None, keep_text: bool = True) -> DataFrame:
    """Adds ``base`` (pattern spans) and ``secrets`` (those and the method's, by start and kind) to every document.

    A span has start, kind (place in BASE, then the method's), end and value; starts and ends are
    code points, the end exclusive. The method adds runs of LEAST_RUN key characters or more, less what
    pattern spans cover of them. Without ``labelled`` samples they come from the corpus. Null and empty
    texts have none; repeated rows each get their own; columns of these names are replaced. The texts are
    read once: what is found in them is stored, with the texts only if they are to be kept.
    """
    runs = free_name(docs, "runs")
    found = with_runs(with_base(docs.drop("base", "secrets")), name=runs)
    found = stored(found if keep_text else found.drop("text"), "found-runs")
    model, threshold = fit(samples(found, runs=runs) if labelled is None else labelled)
    cells, least = free_name(found, "model"), free_name(found, "threshold")
    modelled = found.withColumns({cells: model.scalar(), least: threshold.scalar()})
    flagged = F.filter(F.col(runs), lambda s: ratio(s["value"], F.col(cells)) >= F.col(least))
    return modelled.withColumn("secrets", F.when(F.size(runs) == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", flagged)))).drop(runs, cells, least)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(b[0]) for b in BASE), F.lit(ADDED))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", labelled: DataFrame | None = None) -> DataFrame:
    """All documents, each secret's characters replaced by one ``mark`` (overlapping spans by one)."""
    found = scan(docs, labelled)
    n = F.length("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("secrets", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, n)))
    return found.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
