"""Text analysis as Column expressions: tokens, possessives, ASCII folding, stop words, Porter stems, query forms.

Everything stays in the JVM. Stemming is an expression of many patterns, so ``stems`` applies it to distinct terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The 33 English stop words in common use by search libraries.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

#: Runs of ASCII letters and digits and of anything beyond ASCII; an apostrophe stays between letters, a point or comma
#: between digits. Possessive, so that the longest run needs no stack.
TOKEN = r"(?:[A-Za-z]++(?:'[A-Za-z]++)*+|[0-9]++(?:[.,][0-9]++)*+|[^\x00-\x7F]++)++"
MAX_TOKEN_BYTES = 255


def _bounded(t: Column) -> Column:
    """A token cut to 255 bytes, at a character."""
    cut = F.regexp_replace(F.call_function("make_valid_utf8", F.substring(F.encode(t, "UTF-8"), 1, MAX_TOKEN_BYTES).cast("string")), "�+$", "")
    return F.when(F.octet_length(t) <= MAX_TOKEN_BYTES, t).otherwise(cut)


def tokenize(text: Column) -> Column:
    """Array of raw tokens, each cut to 255 bytes; what is beyond is dropped."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _bounded)


def strip_possessive(token: Column) -> Column:
    return F.regexp_replace(token, r"^(.+)'[sS]$", "$1")


def ascii_lower(token: Column) -> Column:
    """Folds A-Z only; other letters keep their case."""
    return F.translate(token, UPPER, LOWER)


def is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def analyze_unstemmed(text: Column, stop_words: bool = True) -> Column:
    # A-Z fold before the cut, all at once; only what ends like a possessive meets its pattern
    words = F.transform(tokenize(ascii_lower(text)), lambda t: F.when(F.contains(t, F.lit("'s")), strip_possessive(t)).otherwise(t))
    terms = F.filter(words, lambda t: t != "")
    return F.filter(terms, lambda t: ~is_stop_word(t)) if stop_words else terms


def normalize_query(text: Column) -> Column:
    """The key under which results of a query are cached."""
    return F.trim(F.regexp_replace(ascii_lower(text), r"[ \t\n\x0B\f\r]+", " "))


def sanitize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "))


def with_instruction(text: Column, instruction: str = "Represent this sentence for searching relevant passages: ") -> Column:
    return F.concat(F.lit(instruction), text)


def longest_token(text: Column) -> Column:
    """The longest white-space token, the first of equal ones; null where there is none."""
    parts = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.array_max(F.transform(parts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]


def cache_key(text: Column, k: int) -> Column:
    return F.concat(normalize_query(text), F.lit(f"|{k}"))


def varint_bytes(value: Column) -> Column:
    """How many bytes a value takes in seven-bit groups."""
    return F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).when(value < 1 << 28, 4).otherwise(5)


# --- Porter stemmer

#: Suffixes and replacements of steps 2 and 3 and suffixes of step 4, in the order in which they are tried.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_C, _V = "[^aeiouy]", "[aeiouy]"  # after step 0 a consonant y is written Y
_M0, _M1 = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}"
_CVC = f"{_C}{_V}[^aeiouywxY\\x80-\\x{{10FFFF}}]$"  # a letter beyond ASCII is several bytes and so never ends cvc
_DOUBLE = "(?:" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx0123456789") + "|yY)$"


def _cut(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - n)


def _over0(w: Column) -> Column:
    return w.rlike(_M0)


def _over1(w: Column) -> Column:
    return w.rlike(_M1)


def _first(w: Column, cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out.otherwise(w)


def _step(w: Column, n: int) -> Column:
    """Step n of the stemmer on the working string."""
    if n == 0:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiou])y", "$1Y"), "yy", "yY")
    if n == 1:
        return _first(w, [(w.endswith("sses"), _cut(w, 2)), (w.endswith("ies"), _cut(w, 2)), (w.endswith("ss"), w), (w.endswith("s"), _cut(w, 1))])
    if n == 2:
        cases = [(w.endswith("eed"), F.when(_over0(_cut(w, 3)), _cut(w, 1)).otherwise(w))]
        for s in ("ed", "ing"):  # a mark says that the suffix went
            cases.append((w.endswith(s), F.when(_cut(w, len(s)).rlike(_V), F.concat(_cut(w, len(s)), F.lit("#"))).otherwise(w)))
        return _first(w, cases)
    if n == 3:
        u = _cut(w, 1)
        e = F.concat(u, F.lit("e"))
        cases = [(u.rlike("(?:at|bl|iz)$"), e), (u.rlike(_DOUBLE), _cut(u, 1)), (u.rlike("(?:ll|ss|zz)$"), u), (_over0(u) & ~_over1(u) & u.rlike(_CVC), e)]
        return F.when(w.endswith("#"), _first(u, cases)).otherwise(w)
    if n == 4:
        return F.when(w.rlike("[yY]$") & _cut(w, 1).rlike(_V), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)
    if n in (5, 6):
        cases = [(w.endswith(s), F.when(_over0(_cut(w, len(s))), F.concat(_cut(w, len(s)), F.lit(r))).otherwise(w)) for s, r in (STEP2 if n == 5 else STEP3)]
        return _first(w, cases)
    if n == 7:
        cases = []
        for s in STEP4:
            k = 3 if s in ("sion", "tion") else len(s)
            cases.append((w.endswith(s), F.when(_over1(_cut(w, k)), _cut(w, k)).otherwise(w)))
        return _first(w, cases)
    s = _cut(w, 1)
    out = F.when(w.endswith("e") & (_over1(w) | (_over0(w) & ~_over1(w) & ~s.rlike(_CVC))), s).otherwise(w)
    return F.when(w.endswith("ll") & _over1(w), _cut(out, 1)).otherwise(out)


def stem_column(df: DataFrame, term: str, out: str) -> DataFrame:
    """Adds the stem of ``term``; one projection a step keeps the expressions apart."""
    df = df.withColumn("__w", F.col(term))
    for n in range(9):
        df = df.withColumn("__w", _step(F.col("__w"), n))
    return df.withColumn(out, F.when(F.octet_length(term) <= 2, F.col(term)).otherwise(F.translate("__w", "Y", "y"))).drop("__w")


def stems(terms: DataFrame) -> DataFrame:
    """``terms(term)`` -> ``(term, stem)`` for each distinct term."""
    # the aggregate (on keys that are already in place) keeps filters on the stem from being copied into nine nested steps
    return stem_column(terms.select("term").distinct(), "term", "stem").groupBy("term").agg(F.first("stem").alias("stem"))


def analyzed(df: DataFrame, key: str, text: str = "text", stop_words: bool = True, stem: bool = True) -> DataFrame:
    """``(key, pos, term)``: the term stream of each text, in order, with repeats."""
    rows = df.select(key, F.posexplode(analyze_unstemmed(F.col(text), stop_words)).alias("pos", "term"))
    if not stem:
        return rows
    return rows.join(stems(rows), "term").select(key, "pos", F.col("stem").alias("term"))


def _as_sql(spark: SparkSession, make) -> str:
    """The SQL text of an expression over a column ``w``."""
    row = spark.range(1).select(F.lit("").alias("w"))
    return row.select(make(F.col("w")).alias("o"))._jdf.queryExecution().analyzed().projectList().apply(0).child().sql()


def register_analyze(spark: SparkSession, name: str = "analyze_text") -> None:
    """A SQL table function ``name(text)`` of rows ``(pos, term)``: the same expressions, all in the JVM.

    Each step of the stemmer maps the array of terms, so no step is written into the next one.
    """
    quoted = "'" + TOKEN.replace("\\", "\\\\").replace("'", "\\'") + "'"
    word = _as_sql(spark, lambda w: ascii_lower(strip_possessive(_bounded(w))))
    terms = f"filter(transform(regexp_extract_all(text, {quoted}, 0), w -> {word}), w -> w <> '' AND NOT {_as_sql(spark, is_stop_word)})"
    stem = f"transform({terms}, w -> named_struct('t', w, 'w', w))"
    for n in range(9):
        step = _as_sql(spark, lambda w, n=n: _step(w, n))
        stem = f"transform({stem}, s -> named_struct('t', s.t, 'w', element_at(transform(array(s.w), w -> {step}), 1)))"
    stem = f"transform({stem}, s -> CASE WHEN octet_length(s.t) <= 2 THEN s.t ELSE translate(s.w, 'Y', 'y') END)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE (pos INT, term STRING) RETURN SELECT p.pos, p.term FROM posexplode({stem}) AS p(pos, term)")
