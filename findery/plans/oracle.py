"""Pieces of DuckDB SQL that say the same as the column functions."""

from __future__ import annotations

from ..functions import stopwords
from ..functions.text import IRREGULAR
from ..sources.tables import LEXICON, QUERIES


def names(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def norm(x: str) -> str:
    return f"strip_accents(lower({x}))"


def tokens(x: str) -> str:
    irregular = " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    ends = lambda *e: "(" + " OR ".join(f"suffix(t, '{x}')" for x in e) + ")"
    return (
        f"list_transform(regexp_extract_all({norm(x)}, '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda t: CASE "
        f"WHEN t IN ({names(stopwords.ALL)}) THEN t {irregular} "
        f"WHEN length(t) > 5 AND suffix(t, 'ies') THEN left(t, length(t) - 3) || 'y' "
        f"WHEN length(t) > 5 AND {ends('ches', 'shes', 'xes', 'zes')} THEN left(t, length(t) - 2) "
        f"WHEN length(t) > 4 AND suffix(t, 's') AND NOT {ends('ss', 'us', 'is', 'ous', 'as', 'os', 'ys')} THEN left(t, length(t) - 1) "
        "ELSE t END)"
    )


def kept(x: str) -> str:
    """Query terms of a token list."""
    return f"list_filter({x}, lambda t: length(t) > 1 AND t NOT IN ({names(stopwords.ALL)}))"


def stable(x: str) -> str:
    return f"list_filter({kept(tokens(x))}, lambda t: NOT regexp_matches(t, '[0-9]'))"


def corpus(by_language: bool = False) -> str:
    url = "'https://' || lang || '.example.org/doc/' || doc_id" if by_language else "'https://' || source || '.example.org/' || lang || '/' || doc_id"
    return f"corpus AS (SELECT doc_id, {url} AS url, substr(split_part(text, chr(10), 1), 1, 200) AS title, text AS body, lang AS language FROM documents)"


def queries() -> str:
    rows = ", ".join(f"({i}, '{q}', '{t}')" for i, (q, t) in enumerate(QUERIES))
    return f"queries(ord, qid, query) AS (VALUES {rows})"


def lexicon() -> str:
    rows = ", ".join(f"({i}, '{x.key}', '{k}')" for i, x in enumerate(LEXICON) for k in x.keywords)
    more = ", ".join(f"('{x.key}', '{k}')" for x in LEXICON for k in x.expansion)
    return f"lexicon(ord, intent, keyword) AS (VALUES {rows}), more(intent, term) AS (VALUES {more})"


def index() -> str:
    """corpus, tok, post, df, stats, len."""
    one = lambda c, f: f"SELECT doc_id, '{f}' AS field, unnest({tokens(c)}) AS term FROM corpus"
    return f"""{corpus()},
tok AS ({one('title', 'title')} UNION ALL {one('body', 'body')} UNION ALL {one('url', 'url')}),
post AS (SELECT term, doc_id, count(*)::INT AS term_frequency, (count(*) FILTER (WHERE field = 'title'))::INT AS title_frequency,
  (count(*) FILTER (WHERE field = 'body'))::INT AS body_frequency, (count(*) FILTER (WHERE field = 'url'))::INT AS url_frequency FROM tok GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS document_frequency FROM post GROUP BY term),
len AS (SELECT c.doc_id, coalesce(sum(title_frequency), 0) AS lt, coalesce(sum(body_frequency), 0) AS lb, coalesce(sum(url_frequency), 0) AS lu
  FROM corpus c LEFT JOIN post p USING (doc_id) GROUP BY c.doc_id),
stats AS (SELECT count(*) AS n, greatest(coalesce(avg(lt), 0), 1.0) AS s_t, greatest(coalesce(avg(lb), 0), 1.0) AS s_b, greatest(coalesce(avg(lu), 0), 1.0) AS s_u FROM len)"""


def weights() -> str:
    return f"{queries()}, qt AS (SELECT qid, unnest({kept(tokens('query'))}) AS term FROM queries), w0 AS (SELECT qid, term, count(*)::DOUBLE AS weight FROM qt GROUP BY ALL)"


def bm25(name: str, w: str, limit: int = 750) -> str:
    return f"""{name}_all AS (SELECT qid, doc_id, sum(weight * ln(1 + (n - document_frequency + 0.5) / (document_frequency + 0.5)) * tf * 2.2 / (tf + 1.2)) AS score
  FROM (SELECT w.qid, p.doc_id, w.weight, d.document_frequency, s.n,
      2.6 * p.title_frequency / greatest(0.05, 0.65 + 0.35 * lt / s.s_t) + p.body_frequency / greatest(0.05, 0.25 + 0.75 * lb / s.s_b)
      + 1.8 * p.url_frequency / greatest(0.05, 0.8 + 0.2 * lu / s.s_u) AS tf
    FROM {w} w JOIN post p USING (term) JOIN df d USING (term) JOIN len l ON l.doc_id = p.doc_id CROSS JOIN stats s WHERE w.weight > 0) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_all QUALIFY rank <= {limit})"""


def feedback() -> str:
    return f"""fb_docs AS (SELECT qid, doc_id, 1 / ln(rank + 2) AS rw FROM first WHERE rank <= 10),
fb_all AS (SELECT b.qid, p.term, sum(p.body_frequency / greatest(l.lb, 1) * ln(1 + (n - document_frequency + 0.5) / (document_frequency + 0.5)) * rw) AS score
  FROM fb_docs b JOIN post p USING (doc_id) JOIN df USING (term) JOIN len l ON l.doc_id = p.doc_id CROSS JOIN stats
  WHERE length(p.term) >= 3 AND NOT regexp_full_match(p.term, '[0-9]+') AND p.term NOT IN ({names(stopwords.ALL)}) AND document_frequency / n <= 0.4
    AND NOT EXISTS (SELECT 1 FROM qt WHERE qt.qid = b.qid AND qt.term = p.term) GROUP BY ALL),
fb_top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, term) AS r FROM fb_all QUALIFY r <= 12),
fb AS (SELECT qid, term, CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN 0.3 * score / max(score) OVER (PARTITION BY qid) ELSE 0 END AS weight FROM fb_top)"""


def intents() -> str:
    """qi: qid, intent, strength, rank (without general), and iw: their expansion."""
    return f"""{lexicon()},
qall AS (SELECT qid, unnest({tokens('query')}) AS term FROM queries),
qc AS (SELECT qid, l.intent, l.ord, count(*) AS c FROM qall JOIN lexicon l ON l.keyword = qall.term GROUP BY ALL),
qi AS (SELECT qid, intent, ord, round(c / max(c) OVER (PARTITION BY qid), 3) AS strength, row_number() OVER (PARTITION BY qid ORDER BY c DESC, ord) AS rank FROM qc QUALIFY rank <= 2),
iw AS (SELECT q.qid, m.term, max(0.12 * q.strength) AS weight FROM qi q JOIN more m USING (intent)
  WHERE NOT EXISTS (SELECT 1 FROM qall WHERE qall.qid = q.qid AND qall.term = m.term) GROUP BY ALL)"""


def minmax(x: str, by: str = "qid") -> str:
    w = f"OVER (PARTITION BY {by})"
    return (
        f"CASE WHEN abs(max({x}) {w} - min({x}) {w}) <= 1e-9 * greatest(abs(max({x}) {w}), abs(min({x}) {w})) THEN CASE WHEN max({x}) {w} > 0 THEN 1.0 ELSE 0.0 END "
        f"ELSE ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END"
    )
