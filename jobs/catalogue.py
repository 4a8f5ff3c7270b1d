"""The jobs as queries: each runs twice into a new folder under the shared one, and the output is what stands after that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.build import shared_folder
from loomgraph.plans.catalogue_text import tokens_sql
from loomgraph.plans.views import CS, EDGES, NV

from . import base, document_index, impact_report


def _twice(name: str, job) -> DataFrame:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f"{shared_folder(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
        job(spark, sf_dir, out, **base.config(name))
        return job(spark, sf_dir, out, **base.config(name))

    return query


IMPACT = f"""WITH RECURSIVE {NV},
{CS},
{EDGES},
e AS (SELECT frm, "to" FROM edges UNION SELECT parent, id FROM nv WHERE type <> 'file' AND parent IS NOT NULL),
r AS (SELECT id AS symbol, id AS node, 0 AS hop FROM nv WHERE type = 'function' UNION SELECT r.symbol, e.frm, r.hop + 1 FROM r JOIN e ON e."to" = r.node WHERE r.hop < 4),
m AS (SELECT symbol, node, min(hop) AS hop FROM r GROUP BY symbol, node),
s AS (SELECT symbol, CAST(count(*) AS BIGINT) AS affected, CAST(count(*) FILTER (WHERE nv.type = 'file') AS BIGINT) AS files, CAST(max(hop) AS INT) AS furthest FROM m JOIN nv ON nv.id = m.node WHERE hop > 0 GROUP BY symbol),
d AS (SELECT "to" AS symbol, CAST(count(*) AS BIGINT) AS callers, CAST(sum(cnt) AS BIGINT) AS sites FROM edges GROUP BY "to"),
t AS (SELECT symbol, string_agg(frm, ',' ORDER BY place) AS top_callers FROM (SELECT "to" AS symbol, frm, row_number() OVER (PARTITION BY "to" ORDER BY cnt DESC, frm) AS place FROM edges) WHERE place <= 3 GROUP BY symbol)
SELECT f.id AS symbol, f.name, coalesce(callers, 0) AS callers, coalesce(sites, 0) AS sites, coalesce(affected, 0) AS affected, coalesce(files, 0) AS files, coalesce(furthest, 0) AS furthest, coalesce(top_callers, '') AS top_callers, file.name AS file
FROM nv f JOIN nv c ON c.id = f.parent JOIN nv file ON file.id = c.parent LEFT JOIN d ON d.symbol = f.id LEFT JOIN s ON s.symbol = f.id LEFT JOIN t ON t.symbol = f.id WHERE f.type = 'function' AND file.type = 'file'"""

INDEX = "WITH " + tokens_sql("k", "documents", "doc_id", "text") + """, p AS (SELECT id, term, count(*) AS tf FROM k GROUP BY id, term),
l AS (SELECT doc_id AS id, coalesce(lang, 'und') AS lang FROM documents), n AS (SELECT lang, count(*) AS n FROM l GROUP BY lang)
SELECT lang, term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p JOIN l USING (id) JOIN n USING (lang) GROUP BY lang, term"""


def queries() -> dict:
    return {"job1_impact_report": _twice("impact_report", impact_report.run), "job2_document_index": _twice("document_index", document_index.run)}


def oracle_sql() -> dict:
    return {"job1_impact_report": IMPACT, "job2_document_index": INDEX}
