"""IP addresses and action targets."""

import ipaddress

from pyspark.sql import Column, functions as F

from flowguard import constants as K

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = f"^{OCTET}(\\.{OCTET}){{3}}$"


GROUP = "[0-9a-f]{1,4}"
HALF = f"(?:{GROUP}(?::{GROUP})*)?"
#: Either eight groups, or two runs of groups around one double colon.
IPV6 = f"^(?:{GROUP}(?::{GROUP}){{7}}|{HALF}::{HALF})$"
DOTTED_END = r"^(.*:)([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)$"


def _bound(value: Column, body) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pair(text: Column, first: int) -> Column:
    """The group of two octets of a dotted end, as hexadecimal text."""
    high, low = (F.regexp_extract(text, DOTTED_END, i).cast("long") for i in (first, first + 1))
    return F.lower(F.hex(high * 256 + low))


def _groups(text: Column) -> Column:
    """The eight groups without leading zeros, of lower-case text without a zone; null if invalid."""
    dotted = F.when(F.substring_index(text, ":", -1).rlike(IPV4), F.concat(
        F.regexp_extract(text, DOTTED_END, 1), _pair(text, 2), F.lit(":"), _pair(text, 4)))
    plain = F.when(text.contains("."), dotted).otherwise(text)

    def parts(half):
        return F.array_remove(F.split(half, ":"), "")

    def eight(t):
        cut = F.instr(t, "::")
        head = parts(F.when(cut > 0, F.substring_index(t, "::", 1)).otherwise(t))
        tail = parts(F.when(cut > 0, F.substring_index(t, "::", -1)).otherwise(F.lit("")))
        missing = 8 - F.size(head) - F.size(tail)
        whole = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
        return F.when(t.rlike(IPV6) & F.when(cut > 0, missing > 0).otherwise(missing == 0),
                      F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))
    return _bound(plain, eight)


def _shortest(groups: Column) -> Column:
    """Text with the first longest run of two or more zero groups left out."""
    def written(t):
        out = F.lit(None).cast("string")
        for n in range(2, 9):
            run = f"^(.*?):0(?::0){{{n - 1}}}:(.*)$"
            out = F.when(t.rlike(run), F.regexp_replace(t, run, "$1::$2")).otherwise(out)
        return F.regexp_replace(F.coalesce(out, t), "^:(?!:)|(?<!:):$", "")
    mapped = F.concat_ws(":", F.slice(groups, 1, 6)) == "0:0:0:0:0:ffff"

    def octets(k):
        n = F.conv(F.get(groups, F.lit(k)), 16, 10).cast("long")
        return F.concat_ws(".", F.shiftright(n, 8).cast("string"), (n % 256).cast("string"))
    return F.when(mapped, F.concat(F.lit("::ffff:"), octets(6), F.lit("."), octets(7))).otherwise(
        _bound(F.concat(F.lit(":"), F.concat_ws(":", groups), F.lit(":")), written))


def _without_zone(c: Column) -> Column:
    """The address part of an IPv6 text in lower case; null where zone or characters are wrong."""
    zone = F.substring_index(c, "%", -1)
    address = F.when(~c.contains("%"), c).when((zone != "") & (F.length(c) - F.length(
        F.translate(c, "%", "")) == 1), F.substring_index(c, "%", 1))
    return F.lower(F.when(address.rlike("^[0-9A-Fa-f:.]+$"), address))


def compress_ipv6(c: Column) -> Column:
    """Shortest text of an IPv6 address, or null when the text is none; a zone is kept."""
    short = _bound(_groups(_without_zone(c)), lambda g: F.when(g.isNotNull(), _shortest(g)))
    zoned = F.when(c.contains("%"), F.concat(F.lit("%"), F.substring_index(c, "%", -1))).otherwise(
        F.lit(""))
    return F.when(c.contains(":"), F.concat(short, zoned))


def canonical_ip(c: Column) -> Column:
    """Canonical address text or null; only texts with a colon are looked at as IPv6."""
    return F.when(c.contains(":"), compress_ipv6(c)).when(c.rlike(IPV4), c)


def ipv4_number(c: Column) -> Column:
    """The address as a number; null when the text is no IPv4 address."""
    parts = F.split(F.when(c.rlike(IPV4), c), "\\.")
    return sum((F.get(parts, F.lit(i)).cast("long") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
               F.get(parts, F.lit(0)).cast("long") * F.lit(256 ** 3))


def in_v4_blocks(number: Column, blocks=K.INTERNAL_V4_BLOCKS) -> Column:
    hit = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return hit


def ipv6_class(c: Column) -> Column:
    """internal, external or reserved for IPv6 texts; null for anything else."""
    groups = _groups(_without_zone(c))

    def judged(number):
        inside = F.lit(False)
        for block in K.INTERNAL_V6_BLOCKS:
            net = ipaddress.ip_network(block)
            inside = inside | number.between(f"{int(net.network_address):032x}",
                                             f"{int(net.broadcast_address):032x}")
        return (F.when(number.isNull(), F.lit(None).cast("string"))
                .when((number >= "ff" + "0" * 30) | (number == "0" * 32), "reserved")
                .when(inside, "internal").otherwise("external"))
    wide = _bound(groups, lambda g: F.when(g.isNotNull(), F.concat_ws(
        "", F.transform(g, lambda x: F.lpad(x, 4, "0")))))
    return F.when(c.contains(":"), _bound(wide, judged))


def ipv4_class(number: Column) -> Column:
    """internal, external or reserved for the number of an IPv4 address; null without one."""
    return _bound(number, lambda n: (
        F.when(n.isNull(), F.lit(None).cast("string"))
        .when((n == 0) | n.between(224 << 24, (240 << 24) - 1), "reserved")
        .when(in_v4_blocks(n), "internal").otherwise("external")))


def address_class(c: Column) -> Column:
    """internal, external or reserved (multicast, unspecified); null if no address.

    Only texts with a colon go through the IPv6 expressions.
    """
    return F.when(c.contains(":"), ipv6_class(c)).otherwise(ipv4_class(ipv4_number(c)))


def target_scope(kind: Column) -> Column:
    scope = F.lit("unknown")
    for name, value in K.TARGET_SCOPES.items():
        scope = F.when(kind == name, value).otherwise(scope)
    return scope


def is_valid_target(kind: Column, value: Column) -> Column:
    """True for a well-formed target whose address class agrees with its kind."""
    bounded = (F.length(value).between(1, 253)) & (F.trim(value) == value) \
        & ~value.rlike(r"^\s|\s$")
    wanted = F.when(kind == "internal_ip", "internal").when(kind == "external_ip", "external")
    kind_ok = (F.when(kind == "external_domain", value.rlike(K.HOSTNAME_PATTERN))
               .when(wanted.isNotNull(), F.coalesce(address_class(value) == wanted, F.lit(False)))
               .otherwise(False))
    return F.coalesce(bounded & kind_ok, F.lit(False))
