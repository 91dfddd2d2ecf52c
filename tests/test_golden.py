"""Literal cases of the column functions, each evaluated in one job."""

import base64
import time

from pyspark.sql import functions as F

from leadmill.functions import contacts, html, leads, phrases, urls, vocab
from leadmill.functions.text import empty_list
from leadmill.operators import deny, enrich, gate, rank
from leadmill.sources import results


def value(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(row)


def lit(x):
    return F.array(*[F.lit(v) for v in x]) if isinstance(x, list) else F.lit(x)


def test_emails(spark):
    cases = {
        # sorted, distinct, one top-level domain or two
        "write zoe@kiln.net, then bob@kiln.co.uk": ["bob@kiln.co.uk", "zoe@kiln.net"],
        "q@oak.org q@oak.org": ["q@oak.org"],
        # placeholders and public bodies
        "someone@example.com nobody@domain.com": [],
        "desk@roads.gov.in post@fleet.mil": [],
        # spelled out
        "ask mira [at] pottery [dot] com": ["mira@pottery.com"],
        "ivo (at) loom (dot) net": ["ivo@loom.net"],
        # punctuation around and a second at sign
        "Orders: <till@kiln.net>.": ["till@kiln.net"],
        "left@mid@oak.org": ["mid@oak.org"],
        "": [],
    }
    assert value(spark, *[contacts.text_emails(lit(t)) for t in cases]) == list(cases.values())


def test_email_runs_are_read_once(spark):
    run = "kx" * 200_000
    text = lit(f"{run} mira@kiln.net {run} ivo at loom dot net {run}%40")
    got = value(spark, contacts.plain_emails(text), contacts.obfuscated_emails(text), contacts.encoded_emails(text))
    assert got == [["mira@kiln.net"], ["ivo@loom.net"], []]


def test_mailto_and_hidden_emails(spark):
    def shield(a, key=0x1F):
        return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in a)

    got = value(
        spark,
        contacts.mailto_emails(lit(["MAILTO:Zoe@kiln.net?body=hi", "/shop"])),
        contacts.decode_cloudflare(lit(shield("zoe@kiln.net"))),
        contacts.decode_cloudflare(lit("0x1f2e")),
        contacts.decode_cloudflare(lit("1f2")),
        contacts.decode_cloudflare(lit("1f")),
        contacts.encoded_emails(lit("to=zoe%40kiln%2Enet&cc=ivo%40loom%2Enet")),
        contacts.encoded_emails(lit("z+oe%40kiln.net odd%qq%40kiln.net")),
        contacts.cloudflare_emails(lit(f'<b data-cfemail="{shield("Mira@Loom.net")}">')),
    )
    assert got == [
        ["zoe@kiln.net"], "zoe@kiln.net", None, None, None,
        ["ivo@loom.net", "zoe@kiln.net"], ["odd%qq@kiln.net", "z+oe@kiln.net"], ["mira@loom.net"],
    ]


def test_phones(spark):
    cases = {
        "ring (303) 867-2194 after six": ["3038672194"],
        "office +49 30 9018 2734": ["493090182734"],
        "since 1987, fax 0000000000, lot 22222222222": [],
        "+1 (303) 867-2194, also 303-867-2194": ["13038672194"],
    }
    assert value(spark, *[contacts.phones(lit(t)) for t in cases]) == list(cases.values())


def test_whatsapp_and_fallback(spark):
    links = ["https://wa.me/4915112345678", "https://api.whatsapp.com/send?phone=13038672194", "https://wa.me/98765"]
    all_ = contacts.all_contacts(lit("ring 303-867-2194"), lit(links))
    none = contacts.all_contacts(lit("ring 303-867-2194"), empty_list())
    got = value(spark, contacts.whatsapp_numbers(lit(links), lit("")), all_["phones"], none["phones"])
    assert got == [["13038672194", "4915112345678"], [], ["3038672194"]]


def test_social(spark):
    got = value(
        spark,
        contacts.instagram_handles(lit(["https://instagram.com/kiln.studio/"]), lit("")),
        contacts.instagram_handles(empty_list(), lit("tag @kiln_studio, not q@r")),
        contacts.instagram_handles(
            lit(["https://www.instagram.com/p/Zx9/", "https://instagram.com/theme.css/"]), lit("@instagram")
        ),
        contacts.linkedin_urls(
            lit(["http://www.linkedin.com/company/kiln"]), lit("https://linkedin.com/company/kiln/.")
        ),
        contacts.handle_from_url(lit("https://www.instagram.com/kiln.studio/?hl=de")),
        contacts.handle_from_url(lit("https://vk.com/kiln")),
        contacts.handle_from_url(lit("https://instagram.com/p/zx9")),
        contacts.handle_from_url(lit("https://instagram.com/")),
        contacts.company_url(lit("https://www.linkedin.com/company/kiln/about")),
        contacts.company_url(lit("https://kiln.net")),
        contacts.company_url(lit("https://linkedin.com/in/zoe")),
    )
    assert got == [
        ["kiln.studio"], ["kiln_studio"], [], ["https://linkedin.com/company/kiln"],
        "kiln.studio", None, None, None, "https://linkedin.com/company/kiln", None, None,
    ]


def test_hosts(spark):
    cases = {
        "https://www.KilnStudio.net/visit": "kilnstudio.net",
        "plain words": None,
        "http://user:pw@Host_x.com:80/?q=//z": "host_x.com",
        "//cdn.kiln.net/x y": "cdn.kiln.net",
        "http://[::1]:8080/x": "::1",
        "mailto:zoe@kiln.net": None,
        " https://loom.net/": "loom.net",
    }
    assert value(spark, *[urls.domain_of(lit(u)) for u in cases]) == list(cases.values())
    assert value(spark, urls.host_key(lit("KILN")), urls.host_key(lit(""))) == ["kiln", ""]


def test_deny(spark):
    denied = [
        "https://m.reddit.com/r", "https://shop.walmart.com/", "https://roads.gov.uk/",
        "https://physics.edu/", "https://kiln.net/blog/glaze", "https://kiln.net/news/open",
        "https://kiln.net/menu.pdf", "https://kiln.net/b.JPG", "https://trulia.com/", "https://de.indeed.com/",
        "", "mailto:zoe@kiln.net",
    ]
    allowed = ["https://kilnandloom.net/", "https://kilnandloom.net/visit", "https://myreddit.com/"]
    assert value(spark, *[deny.url_denied(lit(u)) for u in denied + allowed]) == [True] * 12 + [False] * 3


def test_deny_tables_and_long_lists(spark):
    long = [f"h{i}.test" for i in range(6000)]
    df = spark.createDataFrame([("https://a.h5999.test/",), ("https://kiln.net/",), ("https://x.gov/",)], "url string")
    table = spark.createDataFrame([(h,) for h in long], "host string")
    for hosts in (long, table):
        flags = {r.url: r.bad for r in deny.flag_denied(df, "url", "bad", hosts).collect()}
        assert flags == {"https://a.h5999.test/": True, "https://kiln.net/": False, "https://x.gov/": True}
    # The first engine's only result on topic is denied, so the next one serves the query.
    rows = [(0, "a.h7.test", "real estate"), (0, "bowls.net", "bowls"), (1, "kiln.net", "real estate")]
    results = spark.createDataFrame(
        [("q", "real_estate", e, i, f"https://{h}/", t) for i, (e, h, t) in enumerate(rows)],
        "query string, niche string, engine_pos int, rank int, url string, title string",
    )
    assert [r.engine_pos for r in rank.first_engine(results, deny_hosts=table).collect()] == [1]
    assert {r.engine_pos for r in rank.first_engine(results).collect()} == {0}


def test_names(spark):
    names = ["Google Garden", "Microsoft Solutions Expert", "Kiln Studio"]
    assert value(spark, *[phrases.name_denied(lit(n)) for n in names]) == [True, True, False]
    names = ["Kiln | Email Marketing | Lists", "Kiln Pottery", ""]
    assert value(spark, *[phrases.is_provider_name(lit(n)) for n in names]) == [True, False, False]


def test_gate(spark):
    cases = [
        ("Three sisters who run a real estate office.", {}, None),
        ("Hand-thrown bowls and glazes.", {}, "scope"),
        ("A real estate trust with an annual report.", {}, "corporate"),
        ("Real estate evenings at the college.", {}, "education"),
        ("Real estate board: create your account.", {}, "portal"),
        ("A digital marketing agency that serves real estate.", {}, "provider"),
        ("Real estate board with for sale by owner offers.", {}, "exclusion"),
        ("Hand-thrown bowls and glazes.", {"require_scope": False}, None),
    ]
    for text, switches, want in cases:
        df = spark.createDataFrame([(text, "real_estate")], "text string, niche string")
        assert gate.candidate_gate(df, **switches).first()["reject_reason"] == want


def test_roots_scores_and_relevance(spark):
    got = value(
        spark,
        urls.to_site_root(lit("https://kiln.net/blog/winter-glaze")),
        urls.to_site_root(lit("https://kiln.net/shops/east/")),
        urls.path_depth(lit("https://kiln.net/")),
        urls.path_depth(lit("https://kiln.net/a/b/")),
    )
    assert got == ["https://kiln.net/", "https://kiln.net/shops/east/", 0, 2]
    rows = [
        ("https://kiln.net/", "Google Estate"), ("https://kiln.net/", "Sign in"),
        ("https://kiln.net/", "Kiln Estate"), ("https://kiln.net/a/b", "Kiln Estate"),
    ]
    df = spark.createDataFrame([(i, "real_estate", *r) for i, r in enumerate(rows)], "i int, niche string, url string, title string")
    s = [r.score for r in rank.score_candidates(df).orderBy("i").collect()]
    assert s[0] == -100 and s[1] < 0 and s[2] > s[3]
    got = value(spark, *[rank.is_relevant(lit(n), lit(h)) for n, h in ((3, 2), (2, 0), (0, 0), (10, 2), (10, 3))])
    assert got == [True, False, True, False, True]


def test_frontier(spark):
    got = value(spark, enrich.frontier_urls(lit("https://kiln.net/"), lit(["/about", "/", "/about"])))[0]
    assert got[0] == "https://kiln.net/about" and "https://kiln.net/" not in got
    assert len(got) == 5 and got.count("https://kiln.net/about") == 1


def test_challenge(spark):
    texts = ["one CAPTCHA before you go on", "ten bowls found", ""]
    assert value(spark, *[html.is_challenge_page(lit(t)) for t in texts]) == [True, False, True]


def test_unwrap(spark):
    def bing(target):
        b64 = base64.b64encode(target.encode()).decode().rstrip("=")
        return f"https://www.bing.com/ck/a?!&mkt=en&u=a1{b64}&ntb=1"

    cases = [
        ("ddg", "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fkiln.net%2Fx&rut=abc", "https://kiln.net/x"),
        ("ddg", "https://duckduckgo.com/l/?uddg=https%253A%252F%252Fkiln.net&rut=abc", "https://kiln.net"),
        ("ddg", "https://kiln.net/plain", None),
        ("bing", bing("https://kiln.net/x"), "https://kiln.net/x"),
        ("bing", bing("https://kiln.net"), "https://kiln.net"),
        ("bing", "https://kiln.net/x", "https://kiln.net/x"),
        ("bing", "ftp://kiln.net/x", None),
        ("ecosia", "https://kiln.net/x", "https://kiln.net/x"),
        ("ecosia", "https://www.ecosia.org/redirect?u=https%3A%2F%2Fkiln.net%2Fx", "https://kiln.net/x"),
        ("searx", "https://kiln.net/x", "https://kiln.net/x"),
        ("searx", "https://search.example/search?q=https%253A%252F%252Fkiln.net%252Fx", "https://kiln.net/x"),
    ]
    assert value(spark, *[urls.UNWRAP[e](lit(h)) for e, h, _ in cases]) == [w for *_, w in cases]


def test_scores(spark):
    def scored(e, w=0, i=0, li=0, p=0):
        s = leads.score({c: F.lit(n) for c, n in zip(vocab.CONTACT_LISTS, (e, w, i, li, p))})
        return F.concat_ws(" ", s.cast("string"), leads.label(s))

    got = value(spark, scored(1), scored(1, 1), scored(5), scored(1, 1, 2, 2, 2), scored(5, 3, 3, 3, 3))
    assert got == ["17 low", "30 medium", "65 high", "52 medium", "100 high"]


def test_html(spark):
    page = """<head><title> Acme &amp; Co </title></head><body><script>a@b.com</script><!-- <a href="/no">x</a> -->
    <p title="a > b">Hi&nbsp;<b>there</b></p><a class=q href='/c?a=1&amp;b=2'>Contact us</a><a href=/plain>x</a>
    <noscript>off</noscript><svg><text>draw</text></svg> caf&eacute; &#x41;&#66; &amp;lt;</body>"""
    got = value(
        spark, html.visible_text(lit(page)), html.strict_text(lit(page)), html.page_links(lit(page)),
        html.contact_links(lit(page)), html.business_name(lit(page), lit("https://x.com")),
        html.business_name(lit("<p>"), lit("https://www.my-biz2go.co.uk/x")), html.business_name(lit(""), lit("")), html.business_name(lit("<p>"), lit("https://öko-haus.de/")),
    )
    assert got == [
        "Acme & Co Hi there Contact us x draw café AB &lt;", "Hi there Contact us x café AB &lt;",
        ["/c?a=1&b=2", "/plain"], ["/c?a=1&b=2"], "Acme & Co", "My-Biz2Go", "Unknown", "Öko-Haus",
    ]


def test_every_default_host_is_denied_with_its_sub_domains(spark):
    hosts = [h for h in vocab.DEFAULT_DENY_HOSTS if h == h.lower()]
    assert len(vocab.DEFAULT_DENY_HOSTS) == len(set(vocab.DEFAULT_DENY_HOSTS)) == 363 and len(hosts) == 362
    urls = [f"https://{start}{h}/" for h in hosts for start in ("", "www.", "a.b.")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert df.filter(~deny.host_denied("url")).isEmpty()
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert deny.drop_denied_hosts(df, "url", table).isEmpty()
    other = spark.createDataFrame([(f"https://un{h}/",) for h in hosts], "url string")
    assert other.filter(deny.host_denied("url")).isEmpty()
    assert deny.drop_denied_hosts(other, "url", table).count() == len(hosts)


def test_rss_challenge_pages_and_first_results(spark):
    def feed(*links):
        return "<rss>" + "".join(f"<item><title>t</title><link>{x}</link></item>" for x in links) + "</rss>"

    rows = [
        (1, feed("https://a.com/", "https://a.com/", "ftp://b.com/", "https://c.com/", "https://d.com/")),
        (2, feed("https://e.com/") + "<p>Please Enable JavaScript</p>"), (3, ""), (4, None), (5, feed("https://f.com/")),
    ]
    captures = spark.createDataFrame(rows, "id int, body string")
    got = results.rss_results(captures, ["id"], limit=2).orderBy("id", "rank").collect()
    assert [(r.id, r.url) for r in got] == [(1, "https://a.com/"), (1, "https://c.com/"), (5, "https://f.com/")]


def test_unclosed_anchors_end_at_the_next_one(spark):
    page = '<a href="/kontakt">Kontakt<a href="/b">News</a> about us <a href="/team">Our <b>team</b>'
    assert value(spark, html.contact_links(F.lit(page))) == [["/kontakt", "/team"]]


def test_unclosed_anchors_take_linear_time(spark):
    def seconds(n):
        page = F.concat(F.repeat(F.lit('<a href="/x">Contact'), n), F.lit('<a href="/last">Team'))
        start = time.perf_counter()
        row = spark.range(1).select(html.contact_links(F.concat(page, F.col("id").cast("string"))).alias("links")).first()
        assert row.links == ["/x"]
        return time.perf_counter() - start

    seconds(100)
    assert seconds(50_000) < 10  # 1 MB
