"""DuckDB text of the stand-in views (mirrors ``sources/standins.py``) for the oracle queries."""

from __future__ import annotations


def folded_sql(v: str, twist: str, width: int = 10) -> str:
    """DuckDB text of ``sources.standins.folded``."""
    own = (f"list_filter(range(0, len({v})), lambda j: (j + {twist} * (j // {width})) % {width} = i)")
    return (f"list_transform(range(0, {width}), lambda i: list_reduce(list_prepend(CAST(0.0 AS DOUBLE), "
            f"list_transform({own}, lambda j: CAST({v}[j + 1] AS DOUBLE))), lambda a, b: a + b) "
            f"* CAST(10.0 AS DOUBLE))")


VIEWS: dict[str, str] = {
    "seqs": """
      SELECT doc_id AS row_id,
             translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')),
                       'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS dna,
             lang AS label_name,
             CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 < 7 THEN 'train'
                  WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 = 7 THEN 'valid'
                  ELSE 'test' END AS split
      FROM documents""",
    "logits": """
      SELECT vec_id AS row_id, label AS y,
             """ + folded_sql("embedding", "0") + """ AS z
      FROM embeddings""",
    "otu": """
      SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS sample_name, l_partkey AS otu_id,
             CASE WHEN l_suppkey % 50 = 0 THEN 0.0 ELSE sum(l_quantity) END AS abundance
      FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "otu_emb": """
      SELECT o.sample_name, o.otu_id, o.abundance, e.embedding AS emb
      FROM otu o JOIN embeddings e
        ON e.vec_id = o.otu_id % (SELECT count(*) FROM embeddings)""",
    "meta": """
      SELECT c_custkey AS row_id,
             CASE c_custkey % 10 WHEN 0 THEN 'not applicable' WHEN 1 THEN NULL
                  ELSE '0.' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') END AS co_occur,
             CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal / 1000.0 END AS ph,
             CAST(n_regionkey AS DOUBLE) AS depth,
             CAST(c_nationkey AS DOUBLE) AS elevation,
             CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS env_biome,
             n_name AS geo_loc_name
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "labelled": "SELECT doc_id AS row_id, quality, toxic FROM labels",
}

# Views that other views read; listed before their readers.
_DEPENDS = {"otu_emb": ["otu"]}


def with_views(names: list[str] | str, body: str) -> str:
    """``WITH v1 AS (...), v2 AS (...) <body>`` for the named stand-in views (dependencies first)."""
    if isinstance(names, str):
        names = names.split()
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
