"""Queries of this subpackage for the driver entry, and their SQL where there is one."""

from __future__ import annotations

from .ann import op3
from .langid import op8
from .minhash import op2
from .mixing import op10
from .pii import op5
from .quality_crf import op7
from .secret_scan import op4
from .sentencepiece_bpe import op1
from .warc import op9
from .webp import op6


def queries():
    return {
        "op1_sentencepiece": op1,
        "op2_minhash": op2,
        "op3_neighbours": op3,
        "op4_secrets": op4,
        "op5_surrogates": op5,
        "op6_webp": op6,
        "op7_quality": op7,
        "op8_language": op8,
        "op9_warc": op9,
        "op10_mixing": op10,
    }


# Letters of base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_CLASSES = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(least(a, b)) AS comp FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(comp, d.doc_id) AS component_id, d.doc_id = coalesce(comp, d.doc_id) AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id"""

_RECORDS = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT)) AS v, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', CAST(1 + ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM q"""


def oracle_sql():
    """Of the other queries some column is beyond SQL (models, images, draws, spans by entropy); their tests hold them against brute force."""
    return {"op2_minhash": _CLASSES, "op9_warc": _RECORDS}
