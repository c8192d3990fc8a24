"""SQL for DuckDB, a twin of each query that SQL can express."""

from __future__ import annotations

from ..sources import chunk
from . import sql as S
from .adapters import LAST


def _tx_trie() -> str:
    return f"WITH {S.TX},\n{S.TX_ITEMS},\n{S.trie()}"


def _state_trie() -> str:
    return f"WITH {S.STATE},\n{S.STATE_ITEMS},\n{S.trie()}"


#: A chunk file's name for printf.
FILE = chunk.filename(1, 0, 1).replace(f"{0:010}", "%010d", 1).replace(f"{1:010}", "%010d")

#: All nodes of the states' tries, and the edges between them.
NODES = """nodes AS MATERIALIZED (SELECT g, h, 2 AS t FROM part UNION ALL SELECT g, h, 1 FROM leaf),
edges AS MATERIALIZED (SELECT c.g, p.h AS parent, c.h AS child FROM part c JOIN part p ON p.g = c.g AND p.d = c.d - 1 AND p.p = substr(c.p, 1, c.d - 1) WHERE c.d > 0
  UNION ALL SELECT l.g, p.h, l.h FROM leaf l JOIN part p ON p.g = l.g AND p.d = l.depth AND p.p = substr(l.path, 1, l.depth)),
ndelta AS MATERIALIZED (SELECT g AS ledger_seq, 'add' AS op, h, t FROM (SELECT DISTINCT g, h, t FROM nodes) a WHERE g > 0 AND NOT EXISTS (SELECT 1 FROM nodes b WHERE b.g = a.g - 1 AND b.h = a.h)
  UNION ALL SELECT g + 1, 'del', h, t FROM (SELECT DISTINCT g, h, t FROM nodes) a WHERE g < 29 AND NOT EXISTS (SELECT 1 FROM nodes b WHERE b.g = a.g + 1 AND b.h = a.h))"""


def _nodes() -> str:
    return f"{_state_trie()},\n{NODES}"


def _headers() -> str:
    return f"WITH {S.both_tries()},\n{S.header()}"


def _bucket(n: str, buckets: str) -> str:
    """Modulo the next power of two, folded back."""
    m = f"CAST(power(2, ceil(log2({buckets}))) AS BIGINT)"
    return f"(CASE WHEN {n} % {m} >= {buckets} THEN {n} % {m} - {m} // 2 ELSE {n} % {m} END)"


PREFIXED = f"WITH {S.TX}, px AS (SELECT tx_hash, CAST('0x' || substr(tx_hash, 1, 12) AS BIGINT) AS nhash FROM tx)"

PACKED = f"""WITH {S.EV},
pk0 AS (SELECT event_id, (event_id * 40503) % 65536 AS mask FROM ev),
pk AS MATERIALIZED (SELECT event_id, mask, bit_count(mask) AS n, array_to_string([CASE WHEN mask & (32768 >> i) <> 0 THEN sha256(encode(event_id || ':' || bit_count(mask >> (16 - i)))) ELSE {S.ZERO} END FOR i IN range(16)], '') AS content, array_to_string([sha256(encode(event_id || ':' || i)) FOR i IN range(bit_count(mask))], '') AS packed FROM pk0)"""

SUMMARY = """sums AS (SELECT ledger_seq, count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'del') AS deleted, sum(n + 33) FILTER (op = 'add') AS bytes FROM delta GROUP BY 1)"""

HD = f"SELECT *, {S.ledger_hash('parent_hash')} AS made FROM hd"


def _chain_violations() -> str:
    drops = "(drops + CASE WHEN ledger_seq = 11 THEN 1 ELSE 0 END)"
    return f"""{_headers()},
bad AS (SELECT * REPLACE (CASE WHEN ledger_seq = 20 THEN sha256(unhex(ledger_hash)) ELSE ledger_hash END AS ledger_hash) FROM hd),
lagged AS (SELECT *, lag(ledger_hash) OVER (ORDER BY ledger_seq) AS before FROM bad),
made AS (SELECT *, {S.ledger_hash('before', drops=drops)} AS made FROM lagged WHERE before IS NOT NULL)
SELECT 'ledger_hash' AS "check", ledger_seq, ledger_hash AS hash, made AS expected, ledger_hash AS got FROM made WHERE made <> ledger_hash"""


def everything() -> dict[str, str]:
    tx, state, nodes = f"WITH {S.TX}", f"WITH {S.STATE}", _nodes()
    return {
        "tx_ids": f"{tx} SELECT event_id, ledger_seq, tx_hash FROM tx",
        "ledger_tx_roots": f"{_tx_trie()} SELECT root.g AS ledger_seq, n AS n_tx, root.h AS root FROM root JOIN (SELECT g, count(*) AS n FROM leaf GROUP BY g) c ON c.g = root.g",
        "trie_node_counts": f"{_tx_trie()} SELECT g AS ledger_seq, CAST(d AS BIGINT) AS depth, count(*) AS inner_nodes FROM part GROUP BY ALL",
        "leaf_placement": f"{_tx_trie()} SELECT g AS ledger_seq, path AS tx_hash, CAST(depth AS BIGINT) AS depth, CAST('0x' || substr(path, CAST(depth AS INT) + 1, 1) AS BIGINT) AS slot, h AS leaf_hash FROM leaf",
        "tx_leaf_parse": f"{tx} SELECT event_id, lower(hex(blob)) AS tx_blob, lower(hex(meta)) AS meta_blob, tx_hash FROM tx",
        "trie_transactions": f"{tx} SELECT ledger_seq, tx_hash, octet_length(blob) AS blob_bytes FROM tx",
        "ledger_headers": f"{_headers()} SELECT ledger_seq, drops, tx_root, account_hash, parent_hash, ledger_hash FROM hd",
        "chain_violations": _chain_violations(),
        "chain_summary": f"{_headers()} SELECT count(*) AS ledgers, count(*) FILTER (made <> ledger_hash) AS wrong FROM ({HD})",
        "tx_id_violations": f"{tx} SELECT 'tx_id' AS \"check\", ledger_seq, tx_hash AS hash, sha256(unhex('54584e00') || blob || encode('!')) AS expected, tx_hash AS got FROM tx WHERE decode(meta) = 'error'",
        "sequence_violations": f"""WITH {S.EV}, l AS (SELECT DISTINCT ledger_seq FROM ev)
SELECT 'missing_header' AS "check", x AS ledger_seq FROM (SELECT unnest(range(2, 32)) AS x) WHERE x NOT IN (SELECT ledger_seq FROM l)
UNION ALL SELECT 'header_out_of_range', ledger_seq FROM l WHERE ledger_seq < 2 OR ledger_seq > 31
UNION ALL SELECT 'delta_out_of_range', ledger_seq FROM l WHERE ledger_seq < 3 OR ledger_seq > 31""",
        "checkpoint_state": f"{state} SELECT k AS key, h AS hash FROM st WHERE ledger_seq = 0",
        "state_at_ledger": f"{state} SELECT k AS key, h AS hash, decode(content) AS content FROM st WHERE ledger_seq = 15",
        "delta_added": f"{state} SELECT ledger_seq, h AS hash FROM delta WHERE op = 'add'",
        "delta_deleted": f"{state} SELECT ledger_seq, h AS hash FROM delta WHERE op = 'del'",
        "replay_final_state": f"{state} SELECT h AS hash, decode(content) AS content FROM st WHERE ledger_seq = {LAST}",
        "replay_mid_state": f"{state} SELECT h AS hash FROM st WHERE ledger_seq = 15",
        "validity_intervals": f"""{state}, live AS (SELECT DISTINCT h, ledger_seq FROM st),
grp AS (SELECT h, ledger_seq, ledger_seq - row_number() OVER (PARTITION BY h ORDER BY ledger_seq) AS island FROM live)
SELECT h AS hash, min(ledger_seq) AS valid_from, CASE WHEN max(ledger_seq) < {LAST} THEN max(ledger_seq) + 1 END AS valid_to FROM grp GROUP BY h, island""",
        "delta_summary": f"""{_headers()}, {SUMMARY}
SELECT hd.ledger_seq, ledger_hash, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(t.n, 0) AS txns, drops
FROM hd LEFT JOIN sums ON sums.ledger_seq = hd.ledger_seq LEFT JOIN (SELECT ledger_seq, count(*) AS n FROM tx GROUP BY 1) t ON t.ledger_seq = hd.ledger_seq""",
        "running_totals": f"""{state}, {SUMMARY}
SELECT l AS ledger_seq, CAST(sum(coalesce(added, 0)) OVER w AS BIGINT) AS total_added, CAST(sum(coalesce(bytes, 0)) OVER w AS BIGINT) AS total_bytes, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS total_txns
FROM (SELECT unnest(range(0, {LAST} + 1)) AS l) LEFT JOIN sums ON ledger_seq = l LEFT JOIN (SELECT ledger_seq AS s, count(*) AS n FROM ev GROUP BY 1) ON s = l WINDOW w AS (ORDER BY l)""",
        "delta_averages": f"""{state}, t AS (SELECT count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'del') AS deleted, CAST(sum(n + 33) FILTER (op = 'add') AS BIGINT) AS bytes FROM delta)
SELECT *, added // {LAST} AS added_per_ledger, bytes // {LAST} AS bytes_per_ledger FROM t""",
        "section_sizes": f"{state} SELECT ledger_seq, count(*) AS added, CAST(sum(n + 33) AS BIGINT) AS bytes FROM delta WHERE op = 'add' GROUP BY 1",
        "trie_reachable": f"{nodes} SELECT g AS ledger_seq, h AS hash, CAST(t AS BIGINT) AS node_type FROM (SELECT DISTINCT * FROM nodes)",
        "trie_diff": f"{nodes} SELECT ledger_seq, op, h AS hash FROM ndelta",
        "root_candidates": f"{nodes} SELECT ledger_seq, h AS hash FROM ndelta a WHERE op = 'add' AND t = 2 AND NOT EXISTS (SELECT 1 FROM edges e JOIN ndelta b ON b.ledger_seq = e.g AND b.h = e.parent AND b.op = 'add' WHERE e.g = a.ledger_seq AND e.child = a.h)",
        "closure_violations": f"{nodes} SELECT g AS ledger_seq, parent, child FROM edges WHERE NOT (parent LIKE '00%' OR parent LIKE '7%') AND (child LIKE '00%' OR child LIKE '7%')",
        "node_hash_violations": f"{state} SELECT ledger_seq, h AS hash, sha256(content || encode('!')) AS expected FROM st WHERE ledger_seq % 2 = 1",
        "dedup_nodes": f"{tx}, c AS (SELECT tx_hash, blob, event_id FROM tx WHERE NOT (event_id % 7 = 0 AND event_id % 2 = 0) OR event_id % 10 = 0) SELECT DISTINCT tx_hash AS hash, octet_length(blob) AS bytes FROM c",
        "shard_priority": f"""{tx}, c AS (SELECT tx_hash, event_id, event_id % 2 AS s FROM tx UNION ALL SELECT tx_hash, event_id, 1 FROM tx WHERE event_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY s) AS k FROM c WHERE NOT (event_id % 7 = 0 AND s = 0))
SELECT tx_hash AS hash, CAST(s AS BIGINT) AS shard_ord FROM r WHERE k = 1""",
        "bucket_placement": f"{PREFIXED}, b AS (SELECT greatest(1, CAST(ceil(count(*) / (227 * 0.5)) AS BIGINT)) AS n FROM px) SELECT tx_hash, nhash, {_bucket('nhash', 'b.n')} AS bucket FROM px, b",
        "spill_blocks": f"{PREFIXED}, r AS (SELECT tx_hash, nhash % 8 AS bucket, row_number() OVER (PARTITION BY nhash % 8 ORDER BY nhash, tx_hash) - 1 AS rn FROM px) SELECT tx_hash, bucket, rn // 227 AS block, rn % 227 AS slot FROM r",
        "record_offsets": f"{tx} SELECT tx_hash AS hash, octet_length(blob) AS size, CAST(92 + coalesce(sum(octet_length(blob) + 38) OVER (ORDER BY tx_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM tx",
        "sparse_inner_decode": f"{PACKED} SELECT event_id, CAST(n AS BIGINT) AS children, sha256(unhex(content)) AS content_sha256 FROM pk",
        "compressed_inner_decode": f"{PACKED} SELECT event_id, sha256(unhex(content)) AS content_sha256 FROM pk",
        "value_codecs": f"""{PACKED} SELECT event_id, codec, CASE WHEN codec IN ('full', 'raw', 'sparse') THEN sha256(unhex(content || '02')) END AS wire_sha256
FROM pk, (VALUES ('full'), ('raw'), ('short'), ('sparse'), ('unknown')) c(codec)""",
        "lz4_values": f"{tx} SELECT tx_hash AS hash, CAST(1 AS BIGINT) AS node_type, true AS same FROM tx",
        "vl_lengths": f"""WITH n AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)
SELECT doc_id, n, lower(hex({S.vl('n')})) AS prefix, CAST(CASE WHEN n <= 192 THEN 1 WHEN n <= 12480 THEN 2 ELSE 3 END AS BIGINT) AS width, n AS decoded FROM n""",
        "tx_by_hash": f"{tx} SELECT event_id, ledger_seq, tx_hash, decode(blob) AS blob FROM tx WHERE tx_hash = (SELECT min(tx_hash) FROM tx)",
        "tx_by_ledger_index": f"{tx} SELECT ledger_seq, CAST(3 AS BIGINT) AS idx, tx_hash, lower(hex(blob)) AS tx_blob, lower(hex(meta)) AS meta_blob FROM tx WHERE ledger_seq = 7 ORDER BY tx_hash LIMIT 1 OFFSET 3",
        "ledger_detail": f"{tx} SELECT row_number() OVER (ORDER BY tx_hash) - 1 AS idx, tx_hash, octet_length(blob) AS blob_bytes, octet_length(meta) AS meta_bytes FROM tx WHERE ledger_seq = 7",
        "canonical_order": f"{tx} SELECT ledger_seq, row_number() OVER (PARTITION BY ledger_seq ORDER BY tx_hash) - 1 AS idx, tx_hash FROM tx",
        "account_ledgers": f"{tx} SELECT ledger_seq, count(*) AS txns, min(tx_hash) AS first_hash FROM tx WHERE user_id = 3 AND ledger_seq BETWEEN 5 AND 20 GROUP BY 1",
        "chunk_index": f"{tx} SELECT ledger_seq // 10 * 10 AS start_ledger, max(ledger_seq) AS last_ledger, count(DISTINCT ledger_seq) AS ledgers, count(*) AS txns, printf('{FILE}', ledger_seq // 10 * 10, ledger_seq // 10 * 10 + 9) AS file FROM tx GROUP BY ledger_seq // 10",
        "wire_nodes": f"{state} SELECT ledger_seq, h AS hash, sha256(content || unhex('01')) AS wire_sha256, CAST(1 AS BIGINT) AS node_type, h AS back FROM st",
        "chunk_roundtrip": f"""{_headers()}, part AS (SELECT * FROM parts), leaf AS (SELECT * FROM leafs), {NODES},
sums AS (SELECT ledger_seq, count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'del') AS deleted FROM ndelta GROUP BY 1)
SELECT hd.ledger_seq, ledger_hash, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(t.n, 0) AS txns, drops
FROM hd LEFT JOIN sums ON sums.ledger_seq = hd.ledger_seq LEFT JOIN (SELECT ledger_seq, count(*) AS n FROM tx GROUP BY 1) t ON t.ledger_seq = hd.ledger_seq""",
        "range_violations": f"""{state}, c AS (SELECT count(*) FILTER (ledger_seq = 7) AS seven, count(*) FILTER (ledger_seq = {LAST}) AS last FROM delta WHERE op = 'add')
SELECT x AS "check", CAST(k AS BIGINT) AS n FROM c, LATERAL (SELECT unnest(['tx_id', 'node_hash', 'state_root', 'ledger_hash', 'checkpoint_root', 'missing_header', 'closure']) AS x, unnest([1, seven, 1, 3, 1, 1, last]) AS k)""",
        "range_is_clean": "SELECT CAST(0 AS BIGINT) AS violations",
        "index_violations": f"""{_headers()},
bad AS (SELECT * REPLACE (drops + CASE WHEN ledger_seq = 9 THEN 1 ELSE 0 END AS drops, CASE WHEN ledger_seq = 20 THEN sha256(unhex(parent_hash)) ELSE parent_hash END AS parent_hash), parent_hash AS before FROM hd),
made AS (SELECT *, {S.ledger_hash('parent_hash')} AS made FROM bad)
SELECT 'ledger_hash' AS "check", ledger_seq, ledger_hash AS hash, made AS expected, ledger_hash AS got FROM made WHERE made <> ledger_hash
UNION ALL SELECT 'parent_hash', ledger_seq, parent_hash, before, parent_hash FROM made WHERE before <> parent_hash""",
        "chunk_link_violations": f"""{_headers()}
SELECT 'chunk_gap' AS "check", CAST(20 AS BIGINT) AS ledger_seq, CAST(NULL AS VARCHAR) AS hash, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS got
UNION ALL SELECT 'checkpoint_hash', ledger_seq, sha256(unhex(ledger_hash)), ledger_hash, sha256(unhex(ledger_hash)) FROM hd WHERE ledger_seq = 10""",
        "store_roundtrip": f"WITH {S.STATE},\n{S.STATE_ITEMS},\n{S.trie(content=True)} SELECT DISTINCT h AS hash, CAST(2 AS BIGINT) AS node_type, c AS content_sha256 FROM part WHERE g = {LAST} UNION ALL SELECT DISTINCT h, 1, h FROM leaf WHERE g = {LAST}",
        "export_import": f"""WITH {S.both_tries(True)}
SELECT DISTINCT h AS hash, CAST(2 AS BIGINT) AS node_type, c AS content_sha256 FROM (SELECT h, c FROM parts WHERE g = {LAST} UNION ALL SELECT h, c FROM partt)
UNION ALL SELECT DISTINCT h, 1, h FROM leafs WHERE g = {LAST} UNION ALL SELECT DISTINCT h, 4, h FROM leaft""",
        "lake_state": f"WITH {S.STATE},\n{S.STATE_ITEMS},\n{S.trie(content=True)} SELECT DISTINCT h AS hash, CAST(2 AS BIGINT) AS node_type, c AS content_sha256 FROM part WHERE g = 15 UNION ALL SELECT DISTINCT h, 1, h FROM leaf WHERE g = 15",
        "digest_vectors": """SELECT * FROM (VALUES ('abc', 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a'), ('', 'cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce'),
  ('abcdefghbcdefghicdefghijdefghijkefghijklfghijklmghijklmnhijklmnoijklmnopjklmnopqklmnopqrlmnopqrsmnopqrstnopqrstu', '8e959b75dae313da8cf4f72814fc143f8f7779c6eb9f7fa17299aeadb6889018')) t(message, digest)""",
    }
