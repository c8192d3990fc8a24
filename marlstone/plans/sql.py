"""DuckDB twins of the adapters, as common table expressions."""

from __future__ import annotations

from .adapters import LAST

HEX = "0123456789abcdef"
ZERO = "repeat('0', 64)"
#: Depth to which tries are written out; queries over tries assert that no leaf lies deeper.
DEEPEST = 10

EV = "ev AS MATERIALIZED (SELECT event_id, user_id, event_type, ts, props, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS ledger_seq, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
TX = f"""{EV},
tx0 AS (SELECT event_id, user_id, ledger_seq, encode(concat_ws('|', event_id, user_id, event_type, cents, props)) AS blob, encode(event_type) AS meta FROM ev),
tx AS MATERIALIZED (SELECT *, sha256(unhex('54584e00') || blob) AS tx_hash FROM tx0)"""
STATE = f"""{EV},
daily AS (SELECT user_id, ledger_seq, arg_max({{'e': event_id, 't': event_type, 'c': cents}}, {{'ts': ts, 'e': event_id}}) AS x FROM ev GROUP BY ALL),
obj0 AS (SELECT user_id, x, ledger_seq AS valid_from, lead(ledger_seq) OVER (PARTITION BY user_id ORDER BY ledger_seq) AS valid_to FROM daily),
obj1 AS (SELECT sha256(encode(CAST(user_id AS VARCHAR))) AS k, valid_from, valid_to, x FROM obj0 WHERE x.t <> 'error'),
obj AS (SELECT k, valid_from, valid_to, encode(concat_ws('|', x.e, x.c, k)) AS content FROM obj1),
st AS MATERIALIZED (SELECT unnest(range(valid_from, least(coalesce(valid_to - 1, {LAST}), {LAST}) + 1)) AS ledger_seq, k, sha256(content) AS h, content FROM obj),
leaf_add AS (SELECT a.ledger_seq, 'add' AS op, a.h, octet_length(a.content) AS n FROM st a WHERE a.ledger_seq > 0 AND NOT EXISTS (SELECT 1 FROM st b WHERE b.ledger_seq = a.ledger_seq - 1 AND b.h = a.h)),
leaf_del AS (SELECT a.ledger_seq + 1 AS ledger_seq, 'del' AS op, a.h, 0 AS n FROM st a WHERE a.ledger_seq < {LAST} AND NOT EXISTS (SELECT 1 FROM st b WHERE b.ledger_seq = a.ledger_seq + 1 AND b.h = a.h)),
delta AS (SELECT DISTINCT * FROM (SELECT * FROM leaf_add UNION ALL SELECT * FROM leaf_del))"""


def be(n: str, width: int) -> str:
    return f"unhex(lpad(hex({n}), {2 * width}, '0'))"


def vl(n: str) -> str:
    return f"(CASE WHEN {n} <= 192 THEN {be(n, 1)} WHEN {n} <= 12480 THEN {be(f'(49408 + {n} - 193)', 2)} ELSE {be(f'(15794176 + {n} - 12481)', 3)} END)"


TX_ITEMS = f"items AS (SELECT ledger_seq AS g, tx_hash AS path, sha256(unhex('534e4400') || {vl('octet_length(blob)')} || blob || {vl('octet_length(meta)')} || meta || unhex(tx_hash)) AS h FROM tx)"
STATE_ITEMS = "items AS (SELECT ledger_seq AS g, k AS path, h FROM st)"


def lcp(a: str, b: str) -> str:
    return f"(list_position([substr({a}, i, 1) <> substr({b}, i, 1) FOR i IN range(1, 65)], true) - 1)"


def trie(name: str = "", content: bool = False) -> str:
    """From items (g, path, h): leaf{name} with depth, lv{name}{d} (g, p, h), part{name} (g, d, p, h), root{name} (g, h). content: with c, the SHA-256 of a node's content."""
    own_content, kept = (", sha256(unhex({slots})) AS c", ", c") if content else ("", "")
    slots = " || ".join(f"coalesce(max(CASE WHEN s = '{x}' THEN h END), {ZERO})" for x in HEX)
    out = f"""near{name} AS (SELECT *, lag(path) OVER w AS a, lead(path) OVER w AS b FROM items WINDOW w AS (PARTITION BY g ORDER BY path)),
leaf{name} AS MATERIALIZED (SELECT g, path, h, greatest(coalesce({lcp('path', 'a')}, 0), coalesce({lcp('path', 'b')}, 0)) AS depth FROM near{name})"""
    for d in range(DEEPEST, -1, -1):
        # Written with an error() branch so that a leaf beyond DEEPEST can't go unnoticed.
        own = f"SELECT g, substr(path, 1, {d}) AS p, substr(path, {d + 1}, 1) AS s, h FROM leaf{name} WHERE depth = {d}"
        if d == DEEPEST:
            own = f"SELECT g, substr(path, 1, {d}) AS p, substr(path, {d + 1}, 1) AS s, CASE WHEN depth > {d} THEN error('trie too deep') ELSE h END AS h FROM leaf{name} WHERE depth >= {d}"
        else:
            own += f" UNION ALL SELECT g, substr(p, 1, {d}), substr(p, {d + 1}, 1), h FROM lv{name}{d + 1}"
        out += f",\nlv{name}{d} AS MATERIALIZED (SELECT g, p, sha256(unhex('4d494e00' || {slots})) AS h{own_content.format(slots=slots)} FROM ({own}) GROUP BY g, p)"
    every = " UNION ALL ".join(f"SELECT g, {d} AS d, p, h{kept} FROM lv{name}{d}" for d in range(DEEPEST + 1))
    return out + f",\npart{name} AS (SELECT * FROM ({every})),\nroot{name} AS (SELECT g, h FROM lv{name}0)"


def header() -> str:
    """hd: a row per ledger with the chained hash. Needs TX and STATE without their ev, which comes first."""
    return f"""
tx_root AS (SELECT * FROM roott),
acc_root AS (SELECT * FROM roots),
per AS (SELECT l.ledger_seq, coalesce(t.h, {ZERO}) AS tx_root, coalesce(a.h, {ZERO}) AS account_hash, 100000000000000000 - 10 * CAST((SELECT count(*) FROM ev WHERE ev.ledger_seq <= l.ledger_seq) AS BIGINT) AS drops FROM (SELECT unnest(range(0, {LAST} + 1)) AS ledger_seq) l LEFT JOIN tx_root t ON t.g = l.ledger_seq LEFT JOIN acc_root a ON a.g = l.ledger_seq),
hd AS (SELECT * FROM (WITH RECURSIVE c(ledger_seq, tx_root, account_hash, drops, parent_hash, ledger_hash) AS (
  SELECT ledger_seq, tx_root, account_hash, drops, {ZERO}, {ledger_hash(ZERO)} FROM per WHERE ledger_seq = 0
  UNION ALL SELECT p.ledger_seq, p.tx_root, p.account_hash, p.drops, c.ledger_hash, {ledger_hash('c.ledger_hash', 'p.')} FROM c JOIN per p ON p.ledger_seq = c.ledger_seq + 1)
  SELECT * FROM c))"""


def ledger_hash(parent: str, p: str = "", drops: str | None = None) -> str:
    return f"sha256(unhex('4c575200') || {be(p + 'ledger_seq', 4)} || {be(drops or p + 'drops', 8)} || unhex({parent}) || unhex({p}tx_root) || unhex({p}account_hash) || {be(f'({p}ledger_seq * 86400)', 4)} || {be(f'(({p}ledger_seq + 1) * 86400)', 4)} || unhex('0a00'))"


def both_tries(content: bool = False) -> str:
    """ev, tx, st and the tries of both, roott and roots."""
    state = STATE.split(",\n", 1)[1]
    return f"{TX},\n{state},\n{TX_ITEMS.replace('items AS', 'itemst AS')},\n{trie('t', content).replace('FROM items ', 'FROM itemst ')},\n{STATE_ITEMS.replace('items AS', 'itemss AS')},\n{trie('s', content).replace('FROM items ', 'FROM itemss ')}"
