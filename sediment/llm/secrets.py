"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers. Native."""

from __future__ import annotations

import math
import random
import re
import string
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, sweep, table

# The three base kinds, in order. A kind's gate is a cheap test that each of its matches passes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_GATE, ACCESS_GATE, HEX_GATE = r"(?i)password|passwd|secret|token|api_?key", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

#: Of the Markov scan: the characters of a candidate and its least length, and the least log-likelihood ratio in nats.
CANDIDATE, CANDIDATE_GATE = r"[A-Za-z0-9+/_-]{20,}={0,2}", r"[A-Za-z0-9+/_-]{20}"
#: What may tell alone in a candidate that as a whole is ordinary, as a key at the end of a path.
PART, PART_GATE = r"[A-Za-z0-9]{20,}", r"[A-Za-z0-9]{20}"
LEAST_RATIO = 12.0
ALPHABET = string.ascii_letters + string.digits + "+/_-="
#: Identifiers of a fixed form whose digits are random by design and tell nothing: they are cut out of a candidate before it is scored.
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: The part of the ordinary sample that is no words: rulers, alphabets, dates and times, words and numbers in paths.
OTHER_SHARE = 0.5

#: Labelled sample of ordinary identifiers and words, joined to longer ones when the model is trained.
IDENTIFIERS = """
get set user name value index count size list map item node file path data read write open close start stop
create update delete insert select from where group order limit table column row key token session request
response client server host port address message content text string number integer float double boolean array
object class function method return import export module package version config option default error warning
info debug trace log print format parse encode decode encrypt hash sign verify login logout account profile
image video audio document page section header footer title label button input output form field email phone
street city country region customer supplier order line part price discount total quantity date time zone year
month week day hour minute second before after between under over through without within about against during
information international development management environment application organization administration
communication responsibility characteristic understanding implementation configuration representation
und nicht eine einer werden wurde haben schaft heit keit ung lich isch gesellschaft entwicklung verwaltung
wissenschaft geschwindigkeit verantwortung zusammenarbeit straße arbeit leben menschen zwischen
une des les dans pour avec sans gouvernement développement environnement responsable connaissance toujours
ment tion eux eau aux oire ière ier elle quel leur notre votre cette
los las una por para con gobierno desarrollo conocimiento sociedad mente cion ciones dad ado ada ando iendo
the and that this with have from they which their would there could other than then them these some into
www http https com org net html index php example mail test main src lib bin usr home local share docs
""".split()


def words_of(rng: random.Random) -> str:
    """An identifier made of words of the sample: joined as is, by case, underscore, dash, slash or number."""
    parts = rng.choices(IDENTIFIERS, k=rng.randint(2, 6))
    style = rng.randrange(8)
    if style == 0:
        return "".join(p.capitalize() for p in parts)
    if style == 1:
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    if style == 2:
        return "_".join(parts).upper()
    if style == 3:
        return "".join(parts).upper()
    if style == 4:
        return "".join(parts) + str(rng.randint(0, 2030))
    return rng.choice(["_", "-", "/", "", "", ""]).join(parts)


def ruler_of(rng: random.Random) -> str:
    """A run of one sign or of two in turn, as under a heading."""
    unit = rng.choice([*ALPHABET, "-=", "_-", "=-", "/-", "xX", "ab", "01"])
    return (unit * 80)[: rng.randint(20, 80)]


def alphabet_of(rng: random.Random) -> str:
    """A stretch of an alphabet or of the digits, again and again."""
    signs = rng.choice([string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.ascii_lowercase])
    at = rng.randrange(len(signs))
    return (signs * 4)[at : at + rng.randint(20, 60)]


def stamp_of(rng: random.Random) -> str:
    """A name with a date and a time."""
    sign = lambda signs: rng.choice([*signs, ""])
    name = rng.choice(["", "log_", "backup-", "run_", rng.choice(IDENTIFIERS) + rng.choice("_-/")])
    day = f"{rng.randint(1990, 2035)}{sign('-_/')}{rng.randint(1, 12):02}{sign('-_/')}{rng.randint(1, 28):02}"
    hour = f"{sign('T_-')}{rng.randint(0, 23):02}{sign('-_')}{rng.randint(0, 59):02}{sign('-_')}{rng.randint(0, 59):02}"
    return name + day + hour + rng.choice(["", f"_{rng.randint(1, 9999)}", "-" + rng.choice(IDENTIFIERS)])


def path_of(rng: random.Random) -> str:
    """Words, of one case, and numbers between signs of one kind."""
    case, sign = rng.choice([str, str, str.capitalize, str.upper]), rng.choice("-_/")
    return rng.choice(["", sign]) + sign.join(rng.choice([case(rng.choice(IDENTIFIERS)), case(rng.choice(IDENTIFIERS)), str(rng.randint(0, 9999))]) for _ in range(rng.randint(3, 9)))


def ordinary_of(rng: random.Random) -> str:
    other = rng.random() < OTHER_SHARE
    return rng.choice([ruler_of, alphabet_of, stamp_of, path_of])(rng) if other else words_of(rng)


def random_of(rng: random.Random) -> str:
    signs = rng.choice([string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.hexdigits[:16]])
    return "".join(rng.choices(signs, k=rng.randint(20, 64)))


def train(samples: list[str], prior: float = 0.5) -> list[list[float]]:
    """Log probabilities of a character after another, with an additive prior."""
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[prior] * len(ALPHABET) for _ in ALPHABET]
    for s in samples:
        known = [at[c] for c in s if c in at]
        for a, b in zip(known, known[1:]):
            counts[a][b] += 1
    return [[math.log(c / sum(row)) for c in row] for row in counts]


@lru_cache(maxsize=4)
def ratios(seed: int = 11, n: int = 20000) -> str:
    """The log-likelihood ratio, random over ordinary, of each pair of characters; in thousandths, comma-joined."""
    rng = random.Random(seed)
    wild, tame = train([random_of(rng) for _ in range(n)]), train([ordinary_of(rng) for _ in range(n)])
    return ",".join(str(round(1000 * (a - b))) for x, y in zip(wild, tame) for a, b in zip(x, y))


def log_ratio(s: str) -> float:
    """What markov_ratio computes, in plain Python."""
    table_, at, n = [int(x) for x in ratios().split(",")], [ALPHABET.index(c) for c in re.sub(UUID, "", s)], len(ALPHABET)
    return sum(table_[a * n + b] for a, b in zip(at, at[1:])) / 1000


def markov_ratio(candidate: Column) -> Column:
    cells = F.split(F.lit(ratios()), ",").cast("array<int>")
    codes = F.transform(F.filter(F.split(F.regexp_replace(candidate, UUID, ""), ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("was"), F.lit(0).cast("long").alias("sum"))
    step = lambda acc, c: F.struct(c.alias("was"), F.when(acc["was"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(cells, acc["was"] * len(ALPHABET) + c)).alias("sum"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"]) / 1000


SPANS = "array<struct<start:long,kind:int,end:long,body:string>>"


def matches(text: Column, pattern: str, kind: int, body: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places in code points; body is a group of the pattern."""
    between, found, inner = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(body))
    parts = F.zip_with(F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("m"), inner.alias("g")), lambda b, x: F.struct(F.length(b).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("len"), x["g"].alias("g")))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        one = F.struct((at + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + p["gap"] + p["len"]).alias("end"), p["g"].alias("body"))
        return at + p["gap"] + p["len"], F.array(one)

    return bound(parts, lambda x: sweep(x, F.lit(0).cast("long"), SPANS, step))


def scan(docs: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """docs (with text) and two arrays of spans (start, kind, end, body): base_spans and more_spans.

    base_spans has the three fixed kinds, leftmost and non-overlapping within a kind; kinds may overlap.
    more_spans has candidates whose log-likelihood ratio reaches least_ratio and, of the others, their runs of
    letters and digits that reach it alone; none that lies within one base span, as that says no more.
    A null or empty text has no spans; repeated rows are scanned each by itself, and an empty table gives no rows.
    A text of any length is scanned whole. Every column of docs stays as it is; the two names are taken over.
    """
    text, empty = F.coalesce("text", F.lit("")), F.array().cast(SPANS)
    gated = lambda gate, spans: F.when(text.rlike(gate), spans).otherwise(empty)
    out = docs.drop("base_spans", "more_spans")
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["body"]) >= MIN_VALUE)
    base = F.concat(gated(ASSIGN_GATE, assign), gated(ACCESS_GATE, matches(text, ACCESS, 1)), gated(HEX_GATE, matches(text, HEX, 2)))
    out = out.withColumn("base_spans", F.array_sort(base))
    outside = lambda s, spans: ~F.exists(spans, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    telling = lambda s: outside(s, F.col("base_spans")) & (markov_ratio(s["body"]) >= least_ratio)
    out = out.withColumn("more_spans", gated(CANDIDATE_GATE, F.filter(matches(text, CANDIDATE, 3), telling)))
    parts = F.filter(matches(text, PART, 3), lambda s: outside(s, F.col("more_spans")) & telling(s))
    return out.withColumn("more_spans", F.array_sort(F.concat("more_spans", gated(PART_GATE, parts))))


def joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by [SECRET] and n_chars, where there is such a column, set anew.

    Overlapping spans become one mark. Documents without secrets stay as they are, null texts too.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.col("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece, F.lit("[SECRET]"))).otherwise(acc["out"]).alias("out"))

    found = scan(docs).withColumn("_spans", F.array_sort(F.concat("base_spans", "more_spans")))
    rest = lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, rest)).otherwise(F.col("text"))
    changed = found.withColumn("_text", text)
    cols = [F.col("_text").alias("text") if c == "text" else F.when(F.size("_spans") > 0, F.length("_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return changed.select(*cols)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base_spans", "more_spans"))).alias("spans"))
