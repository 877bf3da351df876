"""CRC-32 in DuckDB's SQL, which has no function for it: for the oracles only."""

#: A common table of a WITH RECURSIVE clause: one row, the list of the checksums of the 256 bytes.
CRC_TABLE = """crc_steps(i, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) b(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS crc FROM crc_steps WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """The unsigned checksum of a string expression's UTF-8 bytes; crc_table must be among the tables it reads."""
    raw = f"hex(encode({text}))"
    numbers = f"list_transform(range(length({raw}) // 2), lambda k: ('0x' || substr({raw}, (2 * k + 1)::INT, 2))::BIGINT)"
    step = "xor(acc >> 8, crc[(xor(acc, byte) & 255) + 1])"
    return f"xor(list_reduce({numbers}, lambda acc, byte: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
