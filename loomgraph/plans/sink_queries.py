"""Queries for exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..kg import SQL, star_kg, table
from ..operators.lineage import shared_folder
from ..sources import export
from ..streaming import events
from .registry import query


def folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("snk2_json_rows", f"{SQL} SELECT 'entity' AS kind, '{{\"id\":\"' || id || '\",\"text\":\"' || text || '\",\"label\":\"' || label || '\",\"confidence\":' || confidence || '}}' AS value FROM entities UNION ALL SELECT 'relation', '{{\"head\":{{\"id\":\"' || head || '\"}},\"relation_type\":\"' || relation_type || '\",\"tail\":{{\"id\":\"' || tail || '\"}},\"confidence\":' || confidence || '}}' FROM relations")
def _(spark, d):
    return export.json_rows(star_kg(spark, d))


@query("snk3_csv_relations", f"{SQL} SELECT relation_type, r.confidence, h.text AS head_text, h.label AS head_label, head AS head_id, t.text AS tail_text, t.label AS tail_label, tail AS tail_id FROM relations r LEFT JOIN entities h ON h.id = head LEFT JOIN entities t ON t.id = tail")
def _(spark, d):
    return export.csv_tables(star_kg(spark, d))[1]


_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("snk4_rdf_rows", f"{SQL} SELECT '<rdf:Description rdf:about=\"urn:kg:' || id || '\"><kg:text>' || {_ESC.format('text')} || '</kg:text><kg:label>' || label || '</kg:label></rdf:Description>' AS value FROM entities UNION ALL SELECT '<rdf:Description rdf:about=\"urn:kg:' || head || '\"><kg:' || relation_type || ' rdf:resource=\"urn:kg:' || tail || '\"/></rdf:Description>' FROM relations")
def _(spark, d):
    return export.rdf_rows(star_kg(spark, d))


@query("snk5_ttl_rows", f"{SQL} SELECT '<urn:kg:' || id || '> kg:text \"' || text || '\" ; kg:label \"' || label || '\" .' AS value FROM entities UNION ALL SELECT '<urn:kg:' || head || '> kg:' || relation_type || ' <urn:kg:' || tail || '> .' FROM relations")
def _(spark, d):
    return export.ttl_rows(star_kg(spark, d))


@query("snk7_graphml_rows", f"{SQL} SELECT '<node id=\"' || id || '\"><data key=\"label\">' || label || '</data></node>' AS value FROM entities UNION ALL SELECT '<edge source=\"' || head || '\" target=\"' || tail || '\"><data key=\"type\">' || relation_type || '</data></edge>' FROM relations")
def _(spark, d):
    return export.graphml_rows(star_kg(spark, d))


@query("str1_streamed_rate_windows", "SELECT epoch(time_bucket(INTERVAL '60 seconds', ts))::BIGINT AS window_start, count(*) AS n, round(sum(value), 4) AS budget FROM events GROUP BY 1")
def _(spark, d):
    return events.run_to_table(spark, events.rate_windows(events.stream(spark, f"{d}/events.parquet")), folder(spark))


@query("str2_streamed_once_per_key", "SELECT user_id, event_type FROM events GROUP BY ALL")
def _(spark, d):
    once = events.stream(spark, f"{d}/events.parquet").select("user_id", "event_type", "ts")
    return events.run_to_table(spark, events.once_per(once, ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), folder(spark), "append")


@query("str5_session_windows", "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, epoch(date_trunc('second', min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, s")
def _(spark, d):
    return events.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
