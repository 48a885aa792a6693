"""Wire traffic derived from the driver tables with Spark expressions: messages, segments, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(value: Column | int, width: int) -> Column:
    """Big-endian bytes of an unsigned number, as hex text."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value.cast("long")), 2 * width, "0")


def ipv4_header(src: Column, dst: Column, body_len: Column, options: Column, protocol: Column) -> Column:
    """``src`` and ``dst`` as numbers, ``options`` as a count of 4-byte words."""
    return F.concat(
        number(F.lit(0x45) + options, 1), F.lit("00"), number(body_len + 20 + options * 4, 2),
        F.lit("00010000"), F.lit("40"), number(protocol, 1), F.lit("0000"),
        number(src, 4), number(dst, 4),
        F.repeat(F.lit("01010101"), options),
    )


def ipv6_header(src: Column, dst: Column, body_len: Column, protocol: Column) -> Column:
    """Addresses ``2001:db8::<src>`` and ``2001:db8::<dst>``."""
    prefix = F.lit("20010db8" + "0" * 16)
    return F.concat(
        F.lit("60000000"), number(body_len, 2), number(protocol, 1), F.lit("40"),
        prefix, number(src, 4), prefix, number(dst, 4),
    )


def tcp_header(sport: Column, dport: Column, seq: Column, ack: Column, flags: Column) -> Column:
    return F.concat(
        number(sport, 2), number(dport, 2), number(seq, 4), number(ack, 4),
        F.lit("50"), number(flags, 1), F.lit("ffff00000000"),
    )


def ethernet(ethertype: Column, vlan: Column) -> Column:
    """Link header with a VLAN tag where ``vlan`` is not null."""
    tag = F.coalesce(F.concat(F.lit("8100"), number(vlan, 2)), F.lit(""))
    return F.concat(F.lit("020000000001020000000002"), tag, ethertype)


def frame(link: Column, network: Column, transport: Column, payload: Column) -> Column:
    return F.concat(F.unhex(F.concat(link, network, transport)), payload)


def cut_segments(messages: DataFrame, size: int) -> DataFrame:
    """Cut ``bytes`` (starting at stream offset ``start``) into pieces of at most ``size`` bytes."""
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("bytes") / size) - 1, F.lit(0)).cast("int"))
    return messages.withColumn("piece", F.explode(pieces)).withColumns(
        {
            "payload": F.substring("bytes", F.col("piece") * size + 1, F.lit(size)),
            "offset": F.col("start") + F.col("piece") * size,
        }
    ).drop("bytes")
