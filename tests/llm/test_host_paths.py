from tilewright.llm import host_paths as hp

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad box1">Buy now and here and there</div>
<div class="page7"><div class="story-12 body"><h1>Head</h1><p><b>First&nbsp;para <i>gra</i>ph &amp;amp; more<br>line<p>second   %s</p>
<ul><li>one<li>two</ul><form><input value="x">Name</form><div class="comments">Reader says something long enough to matter here</div></div></div>
<aside>aside</aside><footer>&copy; x</footer>"""


def test_blocks_references_and_dropped_parts():
    text = hp.extract(PAGE % "words that go on for a good while", [])
    assert text == "Head First para graph &amp; more line second words that go on for a good while one two"


def test_odd_markup():
    assert hp.extract("plain text < 5 & more", []) == "plain text < 5 & more"
    assert hp.extract("<p>a<p>b</div></p>c<!-- open", []) == "a b c"
    assert hp.extract("<article><h1>x &am</h1><p>x &amp</p></article>", []) == "x &am x &"
    assert hp.extract('<div title="a>b">in</div><a href="x>y<p>z</p>', []).startswith("in")
    assert hp.extract(None, []) == hp.extract("", None) == hp.extract("<html><body></body></html>", []) == ""
    assert hp.extract("<div>" * 3000 + "deep", []) == "deep"
    assert hp.extract("<p>" + "w " * 100_000, []) == " ".join(["w"] * 100_000)


def test_marked_part_with_most_text_stays():
    assert hp.extract('<body><div class="content-with-sidebar"><p>all of the text is in here</p></div></body>', []) == "all of the text is in here"


def test_comments_go_however_long_they_are():
    story, said = "<p>the story is only one line long</p>", "<p>a reader says much more than the story does</p>" * 30
    want = "the story is only one line long"
    assert hp.extract(f'<body><article>{story}<div class="comments">{said}</div></article></body>', []) == want
    assert hp.extract(f'<body><article>{story}</article><div id="comments">{said}</div></body>', []) == want
    assert hp.votes_of(f'<body><article>{story}</article><div id="comments">{said}</div></body>')[0][0] == "/body/article"
    assert hp.extract(f'<body><div class="with-sidebar">{story}<div class="comments"><div class="comment">{said}</div></div></div><footer>one more line of the footer</footer></body>', []) == want
    assert hp.extract(f'<body><h1>A title that is quite long</h1><div class="with-sidebar">{story * 9}</div></body>', []).endswith(want)
    assert hp.extract(f'<body><p>posted by someone three days ago</p><div class="with-sidebar"><h1>T</h1>{story * 9}</div></body>', []).endswith(want)


def test_head_without_an_end_tag_and_short_articles():
    assert hp.extract("<html><head><title>x</title><body><article><p>the whole story</p></article></body></html>", []) == "the whole story"
    assert hp.extract("<head><meta charset='utf-8'><div class='a'>one</div>", []) == "one"
    assert hp.extract("<head><title>t</title>straight text", []) == "straight text"
    said = "<p>a reader says much more than the story does</p>" * 30
    assert hp.extract(f'<body><article><p>short</p></article><div class="comments">{said}</div></body>', []) == "short"
    assert hp.extract(f'<body><div class="ad">{said}</div><div class="x"><p>ten chars.</p></div></body>', []) == "ten chars."


def test_votes_and_scores_together():
    story = "<p>many words of the article that this page is about</p>" * 10
    page = f'<body><section class="b"><p>a tip</p></section><main class="a">{story}</main></body>'
    want = " ".join(["many words of the article that this page is about"] * 10)
    assert hp.extract(page, ["/body/section.b", "/body/main.a"], [60, 40]) == want
    menu = f'<body><section class="b"><p>the story</p><p>of this one page</p></section><main class="a">{story}</main></body>'
    assert hp.extract(menu, ["/body/section.b", "/body/main.a"], [600, 10]) == "the story of this one page"


def test_votes():
    votes = hp.votes_of(PAGE % ("many words " * 20))
    assert votes[0] == ("/html/body/div.page/div.body.story-", 1.0) and votes[1][1] <= 0.75


def test_minority_templates_are_extracted_at_their_own_container(spark):
    words = "words of the story that go on for a good while "
    junk = "<div class='box'><p>links and other things</p></div>"
    forms = ["<article><p>%s</p></article>", *(f"<div class='{c}'><p>%s</p></div>" for c in ("post", "entry", "text", "item"))]
    rows = []
    for k in range(40):
        form = forms[0 if k < 20 else 1 + k % 4]
        rows.append((k, "http://t.example.org/", f"<html><body>{form % (words * 3 + str(k))}{junk}</body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in hp.main_text(df).collect()} == {k: words * 3 + str(k) for k in range(40)}
    assert len(hp.winning_paths(df).first().paths) == 5
    post = f"<html><body><div class='post'><p>{words}</p></div>{junk}</body></html>"
    assert hp.extract(post, ["/html/body/article", "/html/body", "/html/body/div.post"]) == words.strip()


def brute(rows):
    """Votes of all pages in dictionaries, then extraction."""
    votes = {}
    host = lambda u: (u or "").lower().split("://")[-1].split("/")[0] if "://" in (u or "") else ""
    for _, u, h in rows:
        for path, share in hp.votes_of(h):
            v = votes.setdefault(host(u), {})
            v[path] = v.get(path, 0) + int(share * 1e6 + 0.5)
    best = {k: [p for p, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[: hp.WINNERS]] for k, v in votes.items()}
    return {i: hp.extract(h, best.get(host(u))) for i, u, h in rows}


def test_consensus_against_brute_force(spark, monkeypatch):
    long_menu = "<section>" + "<p>far more words in the menu than in the story of this one page</p>" * 9 + "</section>"
    rows = [(k, f"https://A.example.org/{k}", PAGE % ("word " * (20 + k))) for k in range(12)]
    rows += [(20, "http://a.example.org/x", (PAGE % "short").replace("<aside>", long_menu + "<aside>")), (21, None, PAGE % "x"), (22, "not a url", None), (23, "http://b.example.org", ""), (24, "http://b.example.org", "<p>lonely")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute(rows)
    assert want[20].startswith("Head") and "menu" not in want[20]
    for limit in (200_000, -1):
        monkeypatch.setattr(hp, "BROADCAST_ROWS", limit)
        got = hp.main_text(df.withColumnRenamed("page_id", "page_id").selectExpr("*", "1 as host", "2 as paths")).collect()
        assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert hp.main_text(df.limit(0)).count() == 0
    assert len(hp.main_text(df.union(df)).collect()) == 2 * len(rows)
