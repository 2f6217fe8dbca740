"""Queries of the general data-pipeline operators over the ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolith.functions.identity import environment, family_key, message_key
from chronolith.operators.asof_join import attributes_as_known, event_ranges, hot_entities, known_since, levels_of
from chronolith.operators.dedupe import MessageStore
from chronolith.operators import drift
from chronolith.operators.intervals import periods_and_gaps
from chronolith.operators.late import PeriodCounts
from chronolith.operators.nested import flatten_objects, flatten_tables
from chronolith.runtime import materialize, table


def _store(spark: SparkSession, sf_dir: str, columns: list[str]) -> MessageStore:
    """The ledger's arrival batches, upserted in blocks and compacted."""
    ledger = table(spark, sf_dir, "ledger_events")
    return MessageStore(spark).upsert_by_arrival(ledger, message_key(), F.col("id"), "batch_id", columns).compact()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, ["id"]).dropped()


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with exactly one copy of each message."""
    return _store(spark, sf_dir, ["id", "tenant_id", "project_id", "environment_id", "trace_id", "span_id", "seq", "observed_at_unix_ms"]).kept()


#: p2 replays the ledger in so many blocks of arrival; a block holds whole batches.
P2_BLOCKS = 4


def _period_counts(spark: SparkSession, sf_dir: str) -> PeriodCounts:
    store = _store(spark, sf_dir, ["id", "batch_id", "tenant_id", "project_id", "observed_at_unix_ms", "ingested_at_unix_ms"])
    lo, hi = store.arrivals
    periods = PeriodCounts(spark, ["tenant_id", "project_id"])
    block = F.floor((F.coalesce("batch_id", F.lit(lo)) - lo) * P2_BLOCKS / F.lit(hi - lo + 1))
    periods.log(store.kept(), F.col("id"), F.col("observed_at_unix_ms"), F.col("ingested_at_unix_ms"), block)
    for n in range(P2_BLOCKS):
        periods.apply(n)
    return periods


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the recomputed periods say of each message that came after its period's end."""
    periods = _period_counts(spark, sf_dir)
    return periods.corrections().unionByName(periods.rejected())


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by tenant, project and hour after all corrections."""
    return _period_counts(spark, sf_dir).counts().select("tenant_id", "project_id", "period_start_unix_ms", "messages")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, nodes = table(spark, sf_dir, "ledger_events"), table(spark, sf_dir, "memory_nodes")
    spans, reads = table(spark, sf_dir, "node_spans"), table(spark, sf_dir, "read_subjects")
    entity = ["tenant_id", "project_id", "env", "family"]
    asked = reads.select(F.col("event_id").alias("id"), family_key(F.col("canonical_key")).alias("family"))
    asked = asked.join(ledger.select("id", "tenant_id", "project_id", environment(F.col("environment_id")).alias("env"), F.col("observed_at_unix_ms").alias("at"), F.col("ingested_at_unix_ms").alias("by")), "id")
    known = known_since(spans, ledger, message_key(), "node_id", "ingested_at_unix_ms").withColumnRenamed("cited_by", "version")
    closing = ledger.select(F.col("id").alias("valid_to_event_id"), F.col("ingested_at_unix_ms").alias("closed_known_at"))
    versions = nodes.select(
        F.col("id").alias("version"), "tenant_id", "project_id", environment(F.col("environment_id")).alias("env"), family_key(F.col("canonical_key")).alias("family"),
        F.col("valid_from_unix_ms").alias("valid_from"), F.col("valid_to_unix_ms").alias("valid_to"), "valid_to_event_id",
    )
    asked = asked.withColumnRenamed("id", "event_id")
    hot, levels = hot_entities(versions, entity), levels_of(versions, event_ranges(asked, entity), entity)
    versions = versions.join(known, "version").join(closing, "valid_to_event_id", "left")
    return attributes_as_known(asked, versions, entity, hot, levels).select("event_id", F.col("version").alias("node_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_objects(table(spark, sf_dir, "ledger_events"))


#: Flat tables of the payloads: kind of object and columns.
P4_TABLES = {
    "memories": ("memories[]", {"op": "string", "node_kind": "string", "text": "string", "target_node_id": "string"}),
    "citations": ("memories[].cited_spans[]", {"tenant_id": "string", "project_id": "string", "trace_id": "string", "span_id": "string", "seq": "bigint"}),
    "evidence": ("output.evidence[]", {"node_id": "string", "score": "double"}),
}


def _flat_table(name: str):
    def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten_tables(table(spark, sf_dir, "ledger_events"), {name: P4_TABLES[name]})[name]

    flat.__name__ = f"p4_{name}"
    return flat


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines of the span files, their schemas and versions, each written once."""
    rows = materialize(drift.lines(table(spark, sf_dir, "raw_spans")), "lines")
    schema = materialize(drift.field_types(rows), "schema")
    return rows, schema, materialize(drift.versions(schema, table(spark, sf_dir, "span_files")), "versions")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(*_spans(spark, sf_dir)).select("file_id", "change_kind", "field_path", "new_path")


def p5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)[2].select("file_id", "producer", "version_no", "fingerprint", "n_fields", "prev_file_id")


def p5_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps from each version of a producer's schema to the next."""
    rows, schema, version = _spans(spark, sf_dir)
    return drift.migrations(drift.changes(rows, schema, version), version)


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files in one consistent table, one row for each record and field."""
    rows, schema, version = _spans(spark, sf_dir)
    change = materialize(drift.changes(rows, schema, version), "changes")
    return drift.one_table(rows, version, materialize(drift.steps(schema, version, change), "steps"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "memory_nodes")
    rows = nodes.select(
        "tenant_id", "project_id", environment(F.col("environment_id")).alias("environment_id"), family_key(F.col("canonical_key")).alias("family_key"),
        F.col("valid_from_unix_ms").alias("start"), F.col("valid_to_unix_ms").alias("end"),
    )
    return periods_and_gaps(rows, ["tenant_id", "project_id", "environment_id", "family_key"])


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p2_found, p2_counts, p3_found, p4_found, *map(_flat_table, P4_TABLES), p5_found, p5_versions, p5_migrations, p5_table, p6_found)}

_KEYED = """
keyed AS (
  SELECT *, lower(trim(trace_id, E' \\t\\n\\r\\x0b\\x0c')) AS tkey, lower(trim(span_id, E' \\t\\n\\r\\x0b\\x0c')) AS skey
  FROM ledger_events),
copies AS (
  SELECT *, min(id) OVER (PARTITION BY tenant_id, project_id, tkey, skey, seq) AS kept_id FROM keyed)
"""

_WALK = """WITH RECURSIVE t(event_id, path, item, element, v) AS (
          SELECT id, '', '', false, payload::JSON FROM ledger_events WHERE json_valid(payload)
          UNION ALL
          SELECT event_id, c.path, c.item, c.element, c.v FROM (
            SELECT event_id, unnest(CASE json_type(v)
              WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'path': CASE WHEN path = '' THEN k ELSE path || '.' || k END,
                'item': CASE WHEN element THEN path ELSE item END, 'element': false, 'v': json_extract(v, '/' || replace(replace(k, '~', '~0'), '/', '~1'))})
              WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: {'path': path || '[' || i || ']', 'item': item, 'element': true, 'v': json_extract(v, '/' || i)})
              WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(json_extract_string(v, '$'), '^\\s*[\\[{"]') AND json_valid(json_extract_string(v, '$'))
                THEN [{'path': path, 'item': item, 'element': element, 'v': json_extract_string(v, '$')::JSON}] ELSE [] END
              ELSE [] END) AS c FROM t))"""
_CELL = {"bigint": "try_cast(json_extract_string(v, '$.{f}') AS BIGINT)", "double": "try_cast(json_extract_string(v, '$.{f}') AS DOUBLE)", "string": "CASE WHEN json_type(v, '$.{f}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(v, '$.{f}') END"}

_LEAF = """WITH RECURSIVE t(file_id, line_no, path, v) AS (
          SELECT file_id, line_no, '', record::JSON FROM raw_spans WHERE json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record ELSE 'null' END) = 'OBJECT'
          UNION ALL
          SELECT file_id, line_no, CASE WHEN path = '' THEN k ELSE path || '.' || k END, json_extract(v, '/' || replace(replace(k, '~', '~0'), '/', '~1'))
          FROM (SELECT *, unnest(json_keys(v)) AS k FROM t WHERE json_type(v) = 'OBJECT')),
        leaf AS (
          SELECT file_id, line_no, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN 'fraction' ELSE 'whole' END AS type,
            CASE WHEN json_type(v) = 'DOUBLE' AND v::DOUBLE = floor(v::DOUBLE) THEN v::DOUBLE::BIGINT::VARCHAR ELSE v::VARCHAR END AS value
          FROM t WHERE json_type(v) NOT IN ('OBJECT', 'NULL')),
        schema_ AS (SELECT file_id, path, CASE WHEN count(*) FILTER (type = 'array') > 0 THEN 'array' WHEN count(*) FILTER (type = 'boolean') > 0 THEN 'boolean' WHEN count(*) FILTER (type = 'string') > 0 THEN 'string'
          WHEN count(*) FILTER (type = 'fraction') > 0 THEN 'fraction' ELSE 'whole' END AS type FROM leaf GROUP BY ALL),
        ids AS (SELECT file_id, line_no, max(value) FILTER (path = 'trace_id') AS trace, max(value) FILTER (path = 'span_id') AS span FROM leaf GROUP BY ALL),
        held AS (SELECT file_id, trace, span, max(line_no) AS line_no FROM ids WHERE trace IS NOT NULL AND span IS NOT NULL GROUP BY ALL),"""
_CHANGES = """pairs AS (SELECT file_id, lag(file_id) OVER (PARTITION BY producer ORDER BY exported_at, file_id) AS prev FROM span_files),
        shared AS (SELECT p.file_id AS cf, p.prev, a.trace, a.span, a.line_no AS old_line, b.line_no AS new_line FROM pairs p JOIN held a ON a.file_id = p.prev JOIN held b ON b.file_id = p.file_id AND b.trace = a.trace AND b.span = a.span),
        both_ AS (
          SELECT coalesce(o.cf, n.cf) AS cf, coalesce(o.path, n.path) AS path, o.type AS old_type, n.type AS new_type
          FROM (SELECT p.file_id AS cf, s.path, s.type FROM pairs p JOIN schema_ s ON s.file_id = p.prev) o
          FULL JOIN (SELECT p.file_id AS cf, s.path, s.type FROM pairs p JOIN schema_ s ON s.file_id = p.file_id WHERE p.prev IS NOT NULL) n ON o.cf = n.cf AND o.path = n.path),
        gone AS (SELECT b.cf, b.path, b.old_type AS type, list((h.trace, h.span, l.value) ORDER BY h.trace, h.span) AS vals FROM both_ b JOIN shared h ON h.cf = b.cf
          JOIN leaf l ON l.file_id = h.prev AND l.line_no = h.old_line AND l.path = b.path WHERE b.new_type IS NULL GROUP BY ALL),
        new_ AS (SELECT b.cf, b.path, b.new_type AS type, list((h.trace, h.span, l.value) ORDER BY h.trace, h.span) AS vals FROM both_ b JOIN shared h ON h.cf = b.cf
          JOIN leaf l ON l.file_id = h.cf AND l.line_no = h.new_line AND l.path = b.path WHERE b.old_type IS NULL GROUP BY ALL),
        ren AS (SELECT g.cf, g.path, n.path AS new_path FROM gone g JOIN new_ n ON g.cf = n.cf AND g.type = n.type AND g.vals = n.vals),
        changed AS (
        SELECT cf AS file_id, 'renamed' AS change_kind, path AS field_path, new_path FROM ren
        UNION ALL SELECT cf, CASE WHEN new_type IS NULL THEN 'removed' ELSE 'added' END, path, '' FROM both_ b
          WHERE (new_type IS NULL OR old_type IS NULL) AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.cf = b.cf AND b.path IN (r.path, r.new_path))
        UNION ALL SELECT cf, 'retyped', path, '' FROM both_ WHERE old_type <> new_type)"""
_VERSIONS = """prints AS (SELECT file_id, sum(('0x' || substr(md5(path || '|' || CASE type WHEN 'fraction' THEN 'fraction' ELSE type END), 1, 15))::UBIGINT) AS s, count(*) AS n FROM schema_ GROUP BY file_id),
        versions_ AS (
          SELECT f.file_id, producer, row_number() OVER (PARTITION BY producer ORDER BY exported_at, f.file_id)::INT AS version_no, md5(coalesce(s, 0)::HUGEINT::VARCHAR || ':' || coalesce(n, 0)) AS fingerprint, coalesce(n, 0) AS n_fields,
            lag(f.file_id) OVER (PARTITION BY producer ORDER BY exported_at, f.file_id) AS prev_file_id FROM span_files f LEFT JOIN prints USING (file_id))"""

ORACLE = {
    "p5_found": f"{_LEAF} {_CHANGES} SELECT * FROM changed",
    "p5_versions": f"{_LEAF} {_VERSIONS} SELECT * FROM versions_",
    "p5_migrations": f"""{_LEAF} {_CHANGES}, types_ AS (SELECT cf AS file_id, path, new_type FROM both_), {_VERSIONS}
        SELECT v.producer, v.version_no - 1 AS from_version, v.version_no AS to_version, o.fingerprint AS from_fingerprint, v.fingerprint AS to_fingerprint,
          CASE change_kind WHEN 'renamed' THEN 'rename' WHEN 'added' THEN 'default' WHEN 'removed' THEN 'drop' ELSE 'cast' END AS op, c.field_path, c.new_path, t.new_type
        FROM changed c JOIN versions_ v USING (file_id) JOIN versions_ o ON o.file_id = v.prev_file_id JOIN types_ t ON t.file_id = c.file_id AND t.path = CASE WHEN c.new_path = '' THEN c.field_path ELSE c.new_path END""",
    "p1_found": f"WITH {_KEYED} SELECT kept_id, id AS dropped_id FROM copies WHERE id <> kept_id",
    "p1_kept": f"""WITH {_KEYED} SELECT id, tenant_id, project_id, environment_id, trace_id, span_id, seq, observed_at_unix_ms
        FROM copies WHERE id = kept_id""",
    "p2_found": f"""WITH {_KEYED}, cases AS (
          SELECT id, ingested_at_unix_ms AS ing, observed_at_unix_ms - observed_at_unix_ms % 3600000 AS p FROM copies WHERE id = kept_id)
        SELECT id AS event_id, p AS period_start_unix_ms, CASE WHEN ing < p + 7 * 3600000 THEN 'correction' ELSE 'too_late' END AS outcome
        FROM cases WHERE ing >= p + 3600000""",
    "p2_counts": f"""WITH {_KEYED}
        SELECT tenant_id, project_id, observed_at_unix_ms - observed_at_unix_ms % 3600000 AS period_start_unix_ms, count(*) AS messages
        FROM copies WHERE id = kept_id AND ingested_at_unix_ms < observed_at_unix_ms - observed_at_unix_ms % 3600000 + 7 * 3600000
        GROUP BY ALL""",
    "p3_found": f"""WITH {_KEYED},
        first_in AS (SELECT tenant_id, project_id, tkey, skey, seq, min(ingested_at_unix_ms) AS at FROM keyed GROUP BY ALL),
        known AS (
          SELECT s.node_id, min(f.at) AS known_at FROM node_spans s JOIN first_in f
            ON s.tenant_id = f.tenant_id AND s.project_id = f.project_id AND s.seq = f.seq
            AND lower(trim(s.trace_id, E' \t\n\r\x0b\x0c')) = f.tkey AND lower(trim(s.span_id, E' \t\n\r\x0b\x0c')) = f.skey
          GROUP BY s.node_id),
        reads AS (
          SELECT r.event_id, split_part(r.canonical_key, '|rev:', 1) AS fam, e.tenant_id, e.project_id, coalesce(e.environment_id, '') AS env,
            e.observed_at_unix_ms AS at, e.ingested_at_unix_ms AS ing FROM read_subjects r JOIN ledger_events e ON e.id = r.event_id),
        versions AS (
          SELECT n.id, n.tenant_id, n.project_id, coalesce(n.environment_id, '') AS env, split_part(n.canonical_key, '|rev:', 1) AS fam,
            n.valid_from_unix_ms AS vf, n.valid_to_unix_ms AS vt, k.known_at, c.ingested_at_unix_ms AS closed
          FROM memory_nodes n JOIN known k ON k.node_id = n.id LEFT JOIN ledger_events c ON c.id = n.valid_to_event_id)
        SELECT r.event_id, max_by(v.id, (v.vf, v.id)) AS node_id
        FROM reads r JOIN versions v USING (tenant_id, project_id, env, fam)
        WHERE v.vf <= r.at AND v.known_at <= r.ing AND (v.vt IS NULL OR v.vt > r.at OR v.closed IS NULL OR v.closed > r.ing)
        GROUP BY r.event_id""",
    "p4_found": f"""{_WALK}
        SELECT event_id, path AS item_path, item AS parent_path FROM t WHERE element AND json_type(v) = 'OBJECT'""",
    "p6_found": """WITH r AS (
          SELECT tenant_id, project_id, coalesce(environment_id, '') AS environment_id, split_part(canonical_key, '|rev:', 1) AS family_key, valid_from_unix_ms AS s, coalesce(valid_to_unix_ms, 9223372036854775807) AS e
          FROM memory_nodes WHERE valid_to_unix_ms IS NULL OR valid_to_unix_ms > valid_from_unix_ms),
        g AS (SELECT *, max(e) OVER (PARTITION BY tenant_id, project_id, environment_id, family_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
        k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, project_id, environment_id, family_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM g),
        p AS (SELECT tenant_id, project_id, environment_id, family_key, n, min(s) AS s, max(e) AS e FROM k GROUP BY ALL)
        SELECT tenant_id, project_id, environment_id, family_key, 'period' AS piece, s AS start_unix_ms, CASE WHEN e = 9223372036854775807 THEN -1 ELSE e END AS end_unix_ms FROM p
        UNION ALL SELECT tenant_id, project_id, environment_id, family_key, 'gap', e, nx
          FROM (SELECT *, lead(s) OVER (PARTITION BY tenant_id, project_id, environment_id, family_key ORDER BY s) AS nx FROM p) WHERE nx IS NOT NULL""",
}
for _name, (_kind, _fields) in P4_TABLES.items():
    _cells = ", ".join(f"{_CELL[t].format(f=f)} AS {f}" for f, t in _fields.items())
    ORACLE[f"p4_{_name}"] = f"""{_WALK} SELECT event_id, path AS item_path, item AS parent_path, try_cast(regexp_extract(path, '\\[([0-9]+)\\]$', 1) AS INT) AS position, {_cells}
        FROM t WHERE element AND json_type(v) = 'OBJECT' AND regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') = '{_kind}'"""
