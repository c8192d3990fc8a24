"""Schemas and constants of the data model."""

from __future__ import annotations

#: Node types as they are written (fixed values of the format).
TX, STATE, INNER, INNER_COMPRESSED, TX_META = 0, 1, 2, 3, 4
#: Hash prefixes (fixed values of the format).
PREFIX_LEDGER, PREFIX_TX_ID, PREFIX_TX_NODE, PREFIX_INNER = b"LWR\0", b"TXN\0", b"SND\0", b"MIN\0"
ZERO_HASH = bytes(32)

NODE = "hash binary, node_type tinyint, content binary"
DELTA = "ledger_seq bigint, op string, hash binary, node_type tinyint, content binary"
TX_ROW = "ledger_seq bigint, tx_hash binary, tx_blob binary, meta_blob binary"
HEADER = "ledger_seq bigint, ledger_hash binary, account_hash binary, drops decimal(20,0), parent_close_time bigint, close_time bigint, close_time_resolution smallint, close_flags smallint"
