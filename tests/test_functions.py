"""Scalar functions against known values."""

import base64
import datetime as dt
import hmac
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from marlstone.functions import encoding as E
from marlstone.functions import hashing as H
from marlstone.functions import ids as I
from marlstone.functions import net as N
from marlstone.functions import numeric as M
from marlstone.functions import tempo as T
from marlstone.functions import uri as U

L = F.lit


def check(spark, cases):
    """Every case in one projection: name -> (column, wanted)."""
    names = list(cases)
    for i in range(0, len(names), 12):
        part = names[i : i + 12]
        row = spark.range(1).select(*(cases[n][0].alias(f"c{k}") for k, n in enumerate(part))).first()
        for k, n in enumerate(part):
            got = row[k]
            got = got.asDict(True) if hasattr(got, "asDict") else bytes(got) if isinstance(got, bytearray) else got
            assert got == cases[n][1], (n, got, cases[n][1])


DATA = b"Hello world\x00\xff"


def test_encodings(spark):
    cases = {}
    for k, fn in (("base64", base64.b64encode), ("base32", base64.b32encode), ("base16", base64.b16encode)):
        cases[k] = (E.encode(L(DATA), k), fn(DATA).decode())
        cases["from " + k] = (E.decode(L(fn(DATA).decode()), k), DATA)
    for n in range(11):
        cases[f"base32 of {n}"] = (E.encode(L(bytes(range(n))), "base32"), base64.b32encode(bytes(range(n))).decode())
    cases["base62"] = (E.decode62(E.encode62(L(b"\0\0ab"))), b"\0\0ab")
    cases["bits left over"] = (E.decode(L("QQ==".replace("Q=", "R=")), "base64"), None)
    cases["padding missing"] = (E.decode(L("QQ"), "base64"), None)
    cases["lenient"] = (E.decode(L("QQ"), "base64", strict=False), b"A")
    cases["integer"] = (E.read_integer(L(b"\x01\xfe\xff"), 1, 2, True, True), -2)
    cases["chunks"] = (E.chunks(L("abcde"), 2), ["ab", "cd", "e"])
    check(spark, cases)


def test_digests_and_privacy(spark):
    key = L(b"0123456789abcdef")
    check(spark, {
        "hmac": (H.hmac(L(DATA), b"k" * 90, "sha512"), hmac.new(b"k" * 90, DATA, "sha512").hexdigest()),
        "hmac md5": (H.hmac(L(DATA), b"key", "md5"), hmac.new(b"key", DATA, "md5").hexdigest()),
        "lzma": (H.decompress(H.compress(L(DATA), "lzma"), "lzma"), DATA),
        "damaged": (H.decompress(L(b"xx"), "zlib"), None),
        "box": (H.unseal(H.seal(L(DATA), key, 3), key, 3), DATA),
        "box of another place": (H.unseal(H.seal(L(DATA), key, 3), key, 4), None),
        "list": (H.joined_to_list(F.array(L("a"), L("b"), L("c")), "one of"), "one of 'a', 'b' or 'c'"),
        "private": (H.private(L("abc"), "private", "sensitive"), "[***]"),
        "pad": (H.left_pad(L("abc"), 2), "abc"),
    })


def test_uri_resolution(spark):
    base = "http://a/b/c/d;p?q"
    known = {"g:h":"g:h","g":"http://a/b/c/g","./g":"http://a/b/c/g","g/":"http://a/b/c/g/","/g":"http://a/g","//g":"http://g","?y":"http://a/b/c/d;p?y","g?y":"http://a/b/c/g?y","#s":"http://a/b/c/d;p?q#s","":"http://a/b/c/d;p?q",".":"http://a/b/c/",".." :"http://a/b/","../g":"http://a/b/g","../..":"http://a/","../../g":"http://a/g","../../../g":"http://a/g","g;x=1/../y":"http://a/b/c/y","/./g":"http://a/g","g.":"http://a/b/c/g."}
    check(spark, {r: (U.resolved(L(r), L(base)), w) for r, w in known.items()})


def test_uri_parts(spark):
    u = L("http://u:p@ex.com:80/a?x=1&y#f")
    check(spark, {
        "host": (U.host(u), "ex.com"),
        "port": (U.port(u), 80),
        "user": (U.user_info(u), "u:p"),
        "item": (U.query_item(L("http://e/?a=1&b=%20x+y"), "b"), " x+y"),
        "encode": (U.percent_encode(L("a b*~é/+")), "a%20b%2A~%C3%A9%2F%2B"),
        "relative": (U.relative_to(L("http://a/b/x/y?q"), L("http://a/b/c/d")), "../x/y?q"),
        "normal": (U.normalized(L("HTTP://Ex.com/a/./b/../c")), "http://ex.com/a/c"),
        "blank": (U.is_uri(L("http://e/ x")), False),
        "urn": (U.is_uri(L("urn:a:b")), True),
        "iri": (U.is_uri(L("http://é.fr/x"), True), True),
        "iri as uri": (U.is_uri(L("http://é.fr/x")), False),
        "without": (U.removing(u, "query", "fragment"), "http://u:p@ex.com:80/a"),
        "with": (U.updating(u, scheme=L("ftp")), "ftp://u:p@ex.com:80/a?x=1&y#f"),
        "why not": (U.diagnose(L("http://e/%zz")), "invalid-percent-encoding"),
    })


def test_addresses(spark):
    six = {"::1":True,"1::":True,"::":True,"1:2:3:4:5:6:7:8":True,"1:2:3:4:5:6:7":False,"1::2::3":False,"::ffff:1.2.3.4":True,"1:2:3:4:5:6:1.2.3.4":True,"1:2:3:4:5:6:7:1.2.3.4":False,"fe80::1%eth0":False,"1:2:3:4:5:6:7::":True,"::2:3:4:5:6:7:8":True,"12345::":False,":1::":False,"1:2:3:4::6:7:8":True,"1:2:3:4:5:6:7:8:9":False,"1::3:4:5:6:7:8":True,"1::2:3:4:5:6:7:8":False}
    mail = {"a@b.co":True,"a.b@c":True,".a@b":False,'"a b"@c.d':True,"a@[1.2.3.4]":True,"a@[IPv6:::1]":True,"a@-b":False,"a@b.":False,"a"*65+"@b":False}
    host = {"a.b-c.d":True,"-a":False,"a..b":False,".":True,"a.":True,"xn--a":True,"ab--c":False,"x"*64:False}
    check(spark, {a: (N.is_ipv6(L(a)), w) for a, w in six.items()})
    check(spark, {a: (N.is_email(L(a)), w) for a, w in mail.items()})
    check(spark, {a: (N.is_hostname(L(a)), w) for a, w in host.items()})
    check(spark, {"idn": (N.is_idn_hostname(L("실례.테스트")), True), "tone mark": (N.is_idn_hostname(L("\u302ex")), False), "number": (N.ipv4_number(L("1.2.3.4")), 16909060), "zero": (N.is_ipv4(L("01.2.3.4")), False)})


def test_ids(spark):
    ts = L(dt.datetime(2024, 2, 3, 4, 5, 6, 789000))
    cases = {"five": (I.uuid_v5(L("example.com"), "dns"), str(uuid.uuid5(uuid.NAMESPACE_DNS, "example.com"))), "three": (I.uuid_v3(L("é"), "url"), str(uuid.uuid3(uuid.NAMESPACE_URL, "é")))}
    for f in (I.uuid_v1, I.uuid_v6, I.uuid_v7):
        cases[f.__name__] = (I.timestamp(f(ts)).cast("string"), "2024-02-03 04:05:06.789")
    cases["version"], cases["variant"] = (I.version(I.uuid_v7(ts)), 7), (I.variant(I.uuid_v4()), "rfc")
    cases["encoded"] = (I.decoded(I.encoded(L("6fa459ea-ee8a-3ca4-894e-db77e160355e"))), "6fa459ea-ee8a-3ca4-894e-db77e160355e")
    check(spark, cases)


def N_(s):
    return F.lit(s).cast("timestamp_ntz")


def S(c):
    return c.cast("string")


def test_time(spark):
    check(spark, {"pd":(S(T.parse_date(L("2024-02-30"))),None),"pd2":(S(T.parse_date(L("2024-02-29"))),"2024-02-29"),"pt":(T.parse_time(L("23:59:60.5")),500000000),"pt2":(T.parse_time(L("24:00:00")),None),"ft":(T.format_time(L(3723000000100)),"01:02:03.0000001"),
"pdt":(S(T.parse_datetime(L("2024-02-28T23:59:60"))),"2024-02-29 00:00:00"),"po":(T.parse_offset(L("-05:30")),-19800),"fo":(T.format_offset(L(-19800)),"-05:30"),"fo2":(T.format_offset(L(3600),"minimal"),"+01"),
"podt":(T.parse_offset_datetime(L("1998-12-31T15:59:60.5-08:00")),{"local":dt.datetime(1998,12,31,16,0,0,500000),"offset_s":-28800}),"podt2":(T.parse_offset_datetime(L("1998-12-31T22:59:60Z")),None),
"gap":(S(T.resolve(N_("2024-03-10 02:30:00"),"America/New_York")),"2024-03-10 07:30:00"),"gap2":(S(T.resolve(N_("2024-03-10 02:30:00"),"America/New_York","previous_valid")),"2024-03-10 06:30:00"),"gap3":(S(T.resolve(N_("2024-03-10 02:30:00"),"America/New_York","boundary_end")),"2024-03-10 07:00:00"),"gap4":(S(T.resolve(N_("2024-03-10 02:30:00"),"America/New_York","reject")),None),
"ov":(S(T.resolve(N_("2024-11-03 01:30:00"),"America/New_York")),"2024-11-03 05:30:00"),"ov2":(S(T.resolve(N_("2024-11-03 01:30:00"),"America/New_York","next_valid","latest")),"2024-11-03 06:30:00"),"vo":(T.valid_offsets(N_("2024-11-03 01:30:00"),"America/New_York"),[-14400,-18000]),
"pz":(T.parse_zoned_datetime(L("2024-07-01T12:00:00+02:00[Europe/Paris]")),{"local":dt.datetime(2024,7,1,12),"offset_s":7200,"zone":"Europe/Paris"}),
"desc":(T.describe(T.duration(minutes=1,seconds=40)),"1 minute, 40 seconds"),"tot":(T.total(T.duration(hours=25),"days"),1),"comp":(T.component(T.duration(hours=25,minutes=3),"minutes","hours"),3),"tr":(T.truncated(T.duration(seconds=-90),"minutes"),-60000000000),
"per":(T.describe_period(T.parse_period(L("P1Y2M3DT4H5M6.5S"))),"P1Y2M3DT4H5M6.5S"),"perw":(T.describe_period(T.parse_period(L("P3W"))),"P3W"),"per0":(T.parse_period(L("P")),None),"perT":(T.parse_period(L("P1DT")),None),
"addp":(S(T.add_period(N_("2024-01-31 00:00:00"),T.parse_period(L("P1M1DT1H")))),"2024-03-01 01:00:00"),"cal":(S(T.add_calendar(N_("2024-01-31 00:00:00"),months=1)),"2024-02-29 00:00:00")})


def test_zone_detail(spark):
    d = spark.range(1).select(T.zone_detail(N_("2024-07-01 00:00:00"), "America/New_York").alias("d")).first()["d"].asDict()
    assert d == {"designation": "EDT", "offset_s": -14400, "standard_offset_s": -18000, "saving_s": 3600, "is_saving": True, "prior_transition": dt.datetime(2024, 3, 10, 7), "next_transition": dt.datetime(2024, 11, 3, 6)}


def d(s):
    return F.lit(s).cast("decimal(20,6)")


def test_rounding(spark):
    for rule, want in {"up": 3, "down": 2, "toward_zero": 2, "away_from_zero": 3, "nearest_or_away": 3, "nearest_or_even": 2}.items():
        assert spark.range(1).select(M.rounded(d("2.5"), 0, rule)).first()[0] == Decimal(want)


def test_numbers(spark):
    check(spark, {"gcd":(M.gcd(L(48),L(-36)),12),"lcm":(M.lcm(L(4),L(6)),12),"big":(M.big("divide",L("1"),L("3")),"0.3333333333"),"bigp":(M.big("power",L("2"),L("200")),str(2**200)),"bigd0":(M.big("divide",L("-1"),L("0")),"-inf"),"bigq":(M.big("quotient",L("-7"),L("2")),"-3"),"bigm":(M.big("modulo",L("-7"),L("2")),"-1"),"bigs":(M.big("square_root",L("2")),"1.41421356237309504880168872420969807857" ) ,"bits":(M.bit_width(L(255)),8),"tz":(M.trailing_zeros(L(8)),3),"bb":(M.big_from_bytes(M.big_bytes(L("-129"))),"-129"),"not":(M.big("not",L("5")),"-6"),"cmp":(M.big_compare(L("1.0"),L("1.00")),0),"lgcd":(M.big("gcd",L("1.5"),L("0.9")),"0.3"),
"near":(M.nearest_remainder(d("5"),d("2")).cast("double"),1.0),"near2":(M.nearest_remainder(d("7"),d("4")).cast("double"),-1.0),"ex":(M.exactly(L(2.5),"int"),None),"ex2":(M.exactly(L(2.0),"int"),2),"str":(M.stripped(d("1.500")),"1.5")})
