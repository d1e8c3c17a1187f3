"""IPv4/IPv6 text helpers and the keyed, prefix-preserving anonymisation expression.

Every level of an address is rotated by an amount that depends only on the key and on the *original* parent prefix.  For a fixed
parent a rotation is a bijection, so the whole map is injective, keeps prefixes together, never needs a lookup table or a
"values already used" set, and gives the same image in every file and on every executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def is_v4(ip) -> Column:
    return _as_col(ip).rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")


def is_v6(ip) -> Column:
    return v6_groups(ip).isNotNull()


def ip_version(ip) -> Column:
    ip = _as_col(ip)
    return F.when(is_v4(ip), F.lit(4)).when(is_v6(ip), F.lit(6))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: keeps expression trees small where a value is used many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold_dotted_tail(ip: Column) -> Column:
    """``::ffff:1.2.3.4`` to ``::ffff:102:304``."""
    def fold(o: Column) -> Column:
        pair = lambda i: F.lower(F.hex(F.element_at(o, i).cast("bigint") * 256 + F.element_at(o, i + 1).cast("bigint")))
        return F.concat(F.regexp_replace(ip, r"[0-9.]+$", ""), pair(1), F.lit(":"), pair(3))

    return F.when(ip.rlike(r":\d{1,3}(\.\d{1,3}){3}$"), let(F.split(F.regexp_extract(ip, r"([0-9.]+)$", 1), r"\."), fold)).otherwise(ip)


def v6_groups(ip) -> Column:
    """Eight 16-bit groups of an IPv6 text (``::`` expanded, dotted tail folded); NULL when it is not IPv6."""
    ip = F.lower(_as_col(ip))

    def expand(text: Column) -> Column:
        """Replace the gap by as many zero groups as are missing, so the text has eight groups."""
        colons = F.length(text) - F.length(F.replace(text, F.lit(":")))
        return F.when(
            F.instr(text, "::") > 0,
            F.trim(F.replace(text, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.greatest(8 - colons, F.lit(0))))), F.lit(":")),
        ).otherwise(text)

    # An edge gap ("::1", "1::") has one colon less than an inner one, hence the padding before counting.
    padded = F.regexp_replace(F.regexp_replace(_fold_dotted_tail(ip), "^::", "0::"), "::$", "::0")
    texts = F.split(let(padded, expand), ":")
    return F.when(
        (F.instr(ip, ":") > 0) & ip.rlike(r"^[0-9a-f:.]+$"),
        let(
            texts,
            lambda t: F.when(
                (F.size(t) == 8) & F.forall(t, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
                F.transform(t, lambda g: F.conv(g, 16, 10).cast("int")),
            ),
        ),
    )


def v6_text(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g.cast("bigint")))), ":")


def sort_key(ip) -> Column:
    """Text key whose order is: IPv4 by octets, IPv6 by groups, anything else last."""
    ip = _as_col(ip)
    v4 = F.concat(F.lit("4"), F.array_join(F.transform(F.split(ip, r"\."), lambda o: F.lpad(o, 3, "0")), ""))
    v6 = F.concat(F.lit("6"), F.array_join(F.transform(v6_groups(ip), lambda g: F.lpad(F.hex(g.cast("bigint")), 4, "0")), ""))
    return F.when(is_v4(ip), v4).otherwise(F.coalesce(v6, F.concat(F.lit("9"), ip)))


def _h32(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def anonymise_v4(ip, key: str, rotate_host: bool = False) -> Column:
    def rotate(o: Column) -> Column:
        o1, o2, o3, o4 = (F.element_at(o, i).cast("int") for i in (1, 2, 3, 4))
        n1 = F.when(o1 == 0, F.lit(0)).otherwise(1 + (o1 - 1 + 1 + _h32(F.lit(f"{key}|1")) % 254) % 255)
        n2 = (o2 + 1 + _h32(F.concat(F.lit(f"{key}|2|"), o1)) % 255) % 256
        n3 = (o3 + 1 + _h32(F.concat(F.lit(f"{key}|3|"), o1, F.lit("."), o2)) % 255) % 256
        n4 = o4
        if rotate_host:
            n4 = (o4 + 1 + _h32(F.concat(F.lit(f"{key}|4|"), o1, F.lit("."), o2, F.lit("."), o3)) % 255) % 256
        return F.concat_ws(".", n1, n2, n3, n4)

    return let(F.split(_as_col(ip), r"\."), rotate)


def anonymise_v6(ip, key: str, rotate_host: bool = False) -> Column:
    last = 8 if rotate_host else 7

    def rotate(g: Column) -> Column:
        texts = F.transform(g, lambda x: F.lower(F.hex(x.cast("bigint"))))

        def group(value: Column, index: Column) -> Column:
            text = F.concat(F.lit(f"{key}|6|"), index.cast("string"), F.lit("|"), F.array_join(F.slice(texts, 1, index), ":"))
            k = 1 + _h32(text) % 65535
            return F.when(index < last, (value.cast("bigint") + k) % 65536).otherwise(value.cast("bigint"))

        return v6_text(F.transform(g, group))

    return let(v6_groups(ip), rotate)


def anonymise(ip, key: str, rotate_host: bool = False) -> Column:
    """Keyed image of an address text; a value that is no address is returned unchanged."""
    ip = _as_col(ip)
    return (
        F.when(is_v4(ip), anonymise_v4(ip, key, rotate_host))
        .when(F.instr(ip, ":") > 0, F.coalesce(anonymise_v6(ip, key, rotate_host), ip))
        .otherwise(ip)
    )


def v4_from_binary(raw: Column) -> Column:
    """4 bytes to dotted text."""
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10)), "."
    )


def v6_from_binary(raw: Column) -> Column:
    """16 bytes to eight colon-separated groups without leading zeros."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda i: F.lower(F.conv(F.hex(F.substring(raw, i * 2 + 1, F.lit(2))), 16, 16)),
        ),
        ":",
    )


def to_binary(ip) -> Column:
    """Address text to 4 or 16 bytes."""
    ip = _as_col(ip)
    v4 = F.array_join(F.transform(F.split(ip, r"\."), lambda o: F.lpad(F.hex(o.cast("bigint")), 2, "0")), "")
    v6 = F.array_join(F.transform(v6_groups(ip), lambda g: F.lpad(F.hex(g.cast("bigint")), 4, "0")), "")
    return F.unhex(F.when(is_v4(ip), v4).otherwise(v6))
