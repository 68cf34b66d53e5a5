"""DuckDB SQL that says independently what the operators compute."""

from __future__ import annotations

#: Fixed values of the oracle's own, so that a slip in the engine's tables shows.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOKEN = r"(?:[A-Za-z](?:''[A-Za-z])*|[0-9](?:[.,][0-9])*|[^\x00-\x7F])+"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"


def tokens(table: str, key: str, text: str = "text") -> str:
    return f"SELECT {key}, u.pos - 1 AS pos, CASE WHEN octet_length(encode(u.tok)) <= 255 THEN u.tok ELSE list_max(list_filter(list_transform(range(63, 256), lambda n: substr(u.tok, 1, n)), lambda x: octet_length(encode(x)) <= 255)) END AS tok FROM {table}, unnest(regexp_extract_all({text}, '{TOKEN}')) WITH ORDINALITY AS u(tok, pos)"


def unstemmed(table: str, key: str, stop: bool = True, text: str = "text") -> str:
    low = FOLD.format(r"regexp_replace(tok, '^(.+)''[sS]$', '\1')")
    return f"SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS pos, term FROM (SELECT {key}, pos, {low} AS term FROM ({tokens(table, key, text)})) WHERE term <> ''" + (f" AND term NOT IN ({STOPS})" if stop else "")


_C, _V = "[^aeiouy]", "[aeiouy]"


def _m0(x: str) -> str:
    return f"regexp_matches({x}, '^{_C}*{_V}+{_C}')"


def _m1(x: str) -> str:
    return f"regexp_matches({x}, '^{_C}*{_V}+{_C}+{_V}+{_C}')"


def _cut(x: str, n: int) -> str:
    return f"substr({x}, 1, length({x}) - {n})"


def _cvc(x: str) -> str:
    return f"regexp_matches({x}, '{_C}{_V}[^aeiouywxY\\x80-\\x{{10FFFF}}]$')"


def _replace(pairs, test) -> str:
    return "CASE " + " ".join(f"WHEN suffix(w, '{s}') THEN CASE WHEN {test(_cut('w', len(s)))} THEN {_cut('w', len(s))} || '{r}' ELSE w END" for s, r in pairs) + " ELSE w END"


def stems(source: str) -> str:
    """``(term, stem)`` of the distinct terms of ``source(term)``."""
    double = "(?:" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx0123456789") + "|yY)$"
    u = _cut("w", 1)
    steps = [
        r"regexp_replace(regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g')",
        f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_cut('w', 2)} WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN {u} ELSE w END",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_m0(_cut('w', 3))} THEN {u} ELSE w END "
        + " ".join(f"WHEN suffix(w, '{s}') THEN CASE WHEN regexp_matches({_cut('w', len(s))}, '{_V}') THEN {_cut('w', len(s))} || '#' ELSE w END" for s in ("ed", "ing"))
        + " ELSE w END",
        f"CASE WHEN NOT suffix(w, '#') THEN w WHEN regexp_matches({u}, '(?:at|bl|iz)$') THEN {u} || 'e' WHEN regexp_matches({u}, '{double}') THEN {_cut('w', 2)} "
        f"WHEN regexp_matches({u}, '(?:ll|ss|zz)$') THEN {u} WHEN {_m0(u)} AND NOT {_m1(u)} AND {_cvc(u)} THEN {u} || 'e' ELSE {u} END",
        f"CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches({u}, '{_V}') THEN {u} || 'i' ELSE w END",
        _replace(STEP2, _m0),
        _replace(STEP3, _m0),
        "CASE "
        + " ".join(f"WHEN suffix(w, '{s}') THEN CASE WHEN {_m1(_cut('w', n))} THEN {_cut('w', n)} ELSE w END" for s in STEP4 for n in [3 if s in ("sion", "tion") else len(s)])
        + " ELSE w END",
    ]
    inner = f"SELECT DISTINCT term, term AS w FROM ({source})"
    for s in steps:
        inner = f"SELECT term, {s} AS w FROM ({inner})"
    last = f"CASE WHEN suffix(w, 'e') AND ({_m1('w')} OR ({_m0('w')} AND NOT {_m1('w')} AND NOT {_cvc(u)})) THEN {u} ELSE w END"
    inner = f"SELECT term, w AS o, {last} AS w FROM ({inner})"
    inner = f"SELECT term, CASE WHEN suffix(o, 'll') AND {_m1('o')} THEN {u} ELSE w END AS w FROM ({inner})"
    return f"SELECT term, CASE WHEN strlen(term) <= 2 THEN term ELSE replace(w, 'Y', 'y') END AS stem FROM ({inner})"


def analyzed(name: str, table: str, key: str, stop: bool = True, stem: bool = True) -> str:
    """CTEs that end in ``name(key, pos, term)``."""
    if not stem:
        return f"{name} AS MATERIALIZED ({unstemmed(table, key, stop)})"
    return f"{name}_u AS MATERIALIZED ({unstemmed(table, key, stop)}), {name}_s AS MATERIALIZED ({stems(f'SELECT term FROM {name}_u')}), {name} AS MATERIALIZED (SELECT {key}, pos, stem AS term FROM {name}_u JOIN {name}_s USING (term))"


QUERIES = "queries AS (SELECT item_id AS qid, text FROM benchmark)"
QRELS = "qrels AS MATERIALIZED (SELECT b.item_id AS qid, d.doc_id, 1 + coalesce(l.quality, 0) AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l USING (doc_id))"
DOCS = "ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS docid, text FROM documents)"


def index(k1: float = 0.9, b: float = 0.4, stop: bool = True, stem: bool = True) -> str:
    """CTEs: queries, ids, tf(docid, term, tf), dl(docid, dl), st(n, avg_dl), dfs(term, df), post(term, docid, tf, dl, impact, block), q(qid, term)."""
    return f"""{QUERIES}, {DOCS}, {analyzed('dt', 'ids', 'docid', stop, stem)},
tf AS MATERIALIZED (SELECT docid, term, count(*) AS tf FROM dt GROUP BY docid, term),
dl AS MATERIALIZED (SELECT ids.docid, CAST(coalesce(sum(tf.tf), 0) AS BIGINT) AS dl FROM ids LEFT JOIN tf ON ids.docid = tf.docid GROUP BY ids.docid),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avg_dl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
post AS MATERIALIZED (SELECT tf.term, tf.docid, tf.tf, dl.dl,
  ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {k1 + 1}) / (tf + {k1} * ({1 - b} + {b} * dl / avg_dl)) AS impact,
  (row_number() OVER (PARTITION BY tf.term ORDER BY tf.docid) - 1) // 128 AS block
  FROM tf JOIN dfs USING (term) JOIN dl USING (docid), st),
{analyzed('qt', 'queries', 'qid', stop, stem)}, q AS MATERIALIZED (SELECT DISTINCT qid, term FROM qt)"""


def hits(k: int) -> str:
    """CTE ``hits(qid, docid, score, rank)`` after ``index``."""
    return f"""hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank
  FROM (SELECT qid, docid, round(sum(impact), 6) AS score FROM q JOIN post USING (term) GROUP BY qid, docid)) WHERE rank <= {k})"""


def run(k: int) -> str:
    """CTE ``run(qid, doc_id, score, rank)`` after ``hits``."""
    return f"{hits(k)}, run AS MATERIALIZED (SELECT qid, doc_id, score, rank FROM hits JOIN ids USING (docid))"


METRICS = """jr AS MATERIALIZED (SELECT r.qid, r.doc_id, r.score, coalesce(j.rel, 0) AS rel, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, CAST(r.doc_id AS VARCHAR) DESC) AS rank
  FROM run r LEFT JOIN qrels j ON r.qid = j.qid AND r.doc_id = j.doc_id),
got AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS d10, sum(CASE WHEN rank <= 100 THEN rel / log2(rank + 1) ELSE 0 END) AS d100,
  min(CASE WHEN rank <= 10 AND rel >= {t} THEN rank END) AS f10, count(*) FILTER (WHERE rank <= 100 AND rel >= {t}) AS h100, count(*) FILTER (WHERE rank <= 1000 AND rel >= {t}) AS h1000 FROM jr GROUP BY qid),
ide AS (SELECT qid, sum(CASE WHEN r <= 10 THEN rel / log2(r + 1) ELSE 0 END) AS i10, sum(CASE WHEN r <= 100 THEN rel / log2(r + 1) ELSE 0 END) AS i100, count(*) FILTER (WHERE rel >= {t}) AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS r FROM qrels WHERE rel > 0) GROUP BY qid),
pq AS (SELECT qid, round(coalesce(d10, 0) / i10, 6) AS ndcg_10, round(coalesce(d100, 0) / i100, 6) AS ndcg_100, round(coalesce(1 / f10, 0), 6) AS mrr_10,
  round(CASE WHEN w > 0 THEN coalesce(h100, 0) / w ELSE 0 END, 6) AS recall_100, round(CASE WHEN w > 0 THEN coalesce(h1000, 0) / w ELSE 0 END, 6) AS recall_1000 FROM ide LEFT JOIN got USING (qid))"""
