"""IPv6 as column expressions against the standard library."""

import ipaddress
import random

from flowguard import constants as K
from flowguard.functions import network as N


def candidates():
    g = random.Random(6)
    out = ["::", "::1", "1::", "::ffff:1.2.3.4", "::ffff:0102:0304", "fe80::1%eth0", "fe80::1%",
           "1::2%a%b", "::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4",
           "0:0:1:0:0:1:0:0", "1:0:0:2:0:0:3:4", ":::", ":1", "1:", "1::2::3", "12345::", "g::",
           "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8::", "::1.2.3", "::1.2.3.256",
           "::01.2.3.4", "1.2.3.4::", "", "x", "1.2.3.4", " ::1", "::1 ", "FF02::1", "fc00::",
           "FDFF:ffff::", "fe80::", "febf::1", "fec0::1", "2001:DB8:0:0::1", "::ffff:224.0.0.1",
           "%", "::%1", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5::1.2.3.4", "::FFFF:0:0"]
    for _ in range(3000):
        parts = [g.choice(["0", "0", "00", "0001", f"{g.randrange(65536):x}", "FFFF"])
                 for _ in range(g.choice([8, 8, 8, 7, 5, 3, 9]))]
        text = ":".join(parts)
        if g.random() < 0.4:
            k = g.randrange(len(parts))
            text = ":".join(parts[:k]) + "::" + ":".join(parts[k:])
        if g.random() < 0.1:
            text += f":{g.randrange(300)}.{g.randrange(256)}.1.2"
        if g.random() < 0.1:
            k = g.randrange(len(text) + 1)
            text = text[:k] + g.choice(":.%g 0") + text[k:]
        out.append(text)
    return sorted(set(out))


def test_text_and_class(spark):
    values = candidates()
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: (r.text, r.kind) for r in rows.select(
        "v", N.canonical_ip(rows["v"]).alias("text"), N.address_class(rows["v"]).alias("kind"))
        .collect()}
    blocks = [ipaddress.ip_network(b) for b in K.INTERNAL_V6_BLOCKS]
    for v in values:
        try:
            a = ipaddress.ip_address(v)
        except ValueError:
            assert got[v] == (None, None), v
            continue
        assert got[v][0] == str(a), v
        if a.version == 6:
            kind = ("reserved" if a.is_multicast or a.is_unspecified else
                    "internal" if any(a in b for b in blocks) else "external")
            assert got[v][1] == kind, v
    assert sum(t is not None for t, _ in got.values()) > 1000


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([("::1",)], "v string")
    plan = rows.select(N.canonical_ip(rows["v"]), N.address_class(rows["v"]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
