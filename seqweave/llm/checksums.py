"""CRC-32 in SQL that has none, for the queries whose columns hold one."""

from __future__ import annotations

#: A common table expression: the remainders of the polynomial for the 256 values of a byte.
REMAINDERS = "bits AS (SELECT list(c ORDER BY i) AS remainders FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i)))"


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, where bits is joined."""
    read = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1,', 'g'), ',')[:-2], lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce([4294967295] || {read}, lambda c, b: xor(c // 256, remainders[xor(c % 256, b) + 1])), 4294967295)"
