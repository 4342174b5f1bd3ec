"""op9: near-duplicate components of all documents."""

from __future__ import annotations

from . import minhash
from .common import table
from .registry import register

SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS nb FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id
    GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * nb >= 75 * (x.n + y.n - nb)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM d UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node
    WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@register("op9_minhash", SQL)
def op9_minhash(spark, sf_dir):
    """doc_id, size of its shingle set, least document of its component, whether it is kept."""
    return minhash.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
