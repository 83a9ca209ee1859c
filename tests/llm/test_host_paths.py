from tickforge.llm import host_paths

BODY = ["Main title &amp; more", "First  paragraph\n with <b>bold</b> and <a href='#'>a link</a> in a longer line of text.", "Second&nbsp;one: 1 &lt; 2 &#8211; fine, and some more words to read here."]
WANT = "Main title & more\nFirst paragraph with bold and a link in a longer line of text.\nSecond one: 1 < 2 – fine, and some more words to read here."


def page(wrap: str, extra: str = "") -> str:
    body = f"<h1>{BODY[0]}</h1><p>{BODY[1]}<p>{BODY[2]}</p>{extra}"
    return f"""<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header><a href="/">Home</a> Our site</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies, please accept all of them now and for ever, thanks a lot.</p></div>
    <!-- <p>not this</p> -->{wrap.format(body)}
    <aside class=side><p>Related things that nobody asked for, in a rather long paragraph of text.</p></aside>
    <form><label>Mail <input name=x></label><button>Send</button></form><div id="comments"><p>Reader: what a long and interesting comment this is, indeed.</p></div>
    <footer>&copy; us</footer></body></html>"""


def test_main_text_of_several_layouts():
    for wrap in ("<article>{}</article>", "<main><div class='post-12'>{}</div></main>", "<div class=content>{}</div>", "<table><tr><td>{}</td></tr></table>", "<div><section class='entry'><div>{}</div></section></div>"):
        assert host_paths.Page(page(wrap)).extract(None) == WANT
    inside = page("<article>{}</article>", '<div class="ad-slot">Buy this!</div><section class="comments"><p>Reader: no.</p></section><div class="share"><a href=x>Share</a></div>')
    assert host_paths.Page(inside).extract(None) == WANT


def test_marks_inside_a_line_and_about_the_page():
    one = "<div class='with-sidebar no-comments'><article class='post has-comments'><p>A <span class=ad>Buy <span>now</span>!</span> line of <i class='x'>text</i>.</p><p>Next <span hidden>gone<p>Third one.</p></article></div>"
    assert host_paths.Page(one).extract(None) == "A line of text.\nNext\nThird one."
    readers = page("<article>{}</article>", "") .replace("</article>", "</article><article class='comment'><p>" + "A reader's very long remark. " * 60 + "</p></article>")
    assert host_paths.Page(readers).extract(None) == WANT


def test_broken_and_empty_markup():
    assert host_paths.Page("").extract(None) == ""
    assert host_paths.Page("just text & more").extract(None) == "just text & more"
    assert host_paths.Page("<p>one<br>two<p>three</b></i></div>").extract(None) == "one two\nthree"
    assert host_paths.Page("<div><p>open <b>tag <a href='x>y</p></div>").extract(["x"]).startswith("open tag")
    assert host_paths.Page("a < b and <").extract(None) == "a < b and <"
    assert host_paths.Page("<script>never closed <p>x</p>").extract(None) == ""
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert host_paths.Page(deep).extract(None) == "deep"
    assert len(host_paths.Page("<p>" + "long words " * 200_000).extract(None)) == 2_199_999


def test_hosts_agree_on_a_path(spark):
    """One page has more text in a wrapper that the host's other pages don't use for the article."""
    good = "<article>{}</article>"
    odd = page(good, "") .replace("<article>", "<div class='teasers'><p>" + "A teaser line of words that goes on. " * 12 + "</p></div><article>")
    rows = [(i, f"https://a.example.org/{i}", page(good)) for i in range(6)] + [(6, "https://a.example.org/odd", odd), (7, None, page("<main>{}</main>")), (8, "no host", None), (8, "no host", None)]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, path string, salt int").repartition(3)
    got = host_paths.extract(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == WANT for i in range(8)) and text[8] == ""
    assert host_paths.Page(odd).extract(None) != WANT
    assert host_paths.extract(pages.where("page_id > 99")).count() == 0


def test_text_beside_the_path_stays():
    a, b = "forty characters of text in division a..", "Sixty characters of text in the sibling division, number b.."
    page = host_paths.Page(f"<body><div class=wrap><div class=a>{a}</div><div class=b>{b}</div></div></body>")
    assert page.extract([">body>div.wrap>div.a"]) == f"{a}\n{b}"
    apart = host_paths.Page(f"<body><div class=a>{a}</div><div class=b>{b * 2}</div></body>")
    assert apart.extract([">body>div.a"]) == f"{a}\n{b * 2}"


def test_headings_of_the_article_stay():
    lead, text = "A short lead.", "The body of the article. " * 20
    source = f"<body><main><article><header><h1>Title</h1></header><p>{lead}</p><div class=entry-content><p>{text}</p></div><div class=share>Share</div></article></main></body>"
    want = f"Title\n{lead}\n{text.strip()}"
    page = host_paths.Page(source)
    assert page.extract(None) == want
    assert page.extract([">body>main>article>div.entry-content"]) == want


def test_broken_markup_takes_linear_time():
    import time

    n = 1 << 20
    for unit in ("<a ", '<a ">" ', "</script ", "<script ", "<!", "<ul>", "</li>", "<div>", "</nav>"):
        for source in (unit * (n // len(unit)), "<li><div>" + "<ul>" * 40_000 + unit * 40_000 + ">"):
            began = time.time()
            host_paths.Page(source).extract([">div"])
            assert time.time() - began < 6, unit


def test_paths_of_any_depth_are_told_apart():
    deep = "<body>" + "<div class=w>" * 30 + "{}" + "</div>" * 30
    a, b = (host_paths.Page(deep.format(f"<section class={c}><p>Some words of the text here.</p></section>")) for c in "ab")
    assert a.votes()[0][0] != b.votes()[0][0] and a.votes()[0][0].count("div.w") == 30


def labelled(r, layout, k):
    """A page of a layout without telling class names, and its article's blocks."""
    words = lambda n: " ".join(r.choice("sun moon tree house water stone bread light river cloud".split()) + str(r.randint(0, 999)) for _ in range(n))
    want = [words(r.randint(5, 9)), *(words(r.randint(20, 60)) for _ in range(r.randint(2, 5)))]
    body = f"<h2>{want[0]}</h2>" + "".join(f"<p>{x}</p>" for x in want[1:])
    box = "".join(f"<p>{words(9)}</p>" for _ in range(4)) + "<ul>" + "".join(f"<li><a href=x>{words(3)}</a></li>" for _ in range(9)) + "</ul>"
    return f"<body><header>{words(4)}</header><nav><a href=x>Home</a></nav>" + layout.format(body=body, box=box, k=k) + f"<footer>{words(6)}</footer></body>", want


def test_blocks_of_labelled_layouts(spark):
    """Precision and recall of blocks over hosts with one or two templates, with and without the vote."""
    import random

    r = random.Random(31)
    layouts = [
        "<div class=x{k}><div class=y>{body}</div></div><div class=z>{box}</div>",
        "<main><article>{body}</article><section class=q>{box}</section></main>",
        "<table><tr><td class=l>{box}</td><td class=m>{body}</td></tr></table>",
        "<div class=outer><section class=t>{body}</section></div><div class=u><div>{box}</div></div>",
    ]
    rows, want = [], {}
    for host in range(4):
        for k in range(12):
            page_id = host * 100 + k
            source, want[page_id] = labelled(r, layouts[host if k % 3 else (host + 1) % 4], k)
            rows.append((page_id, f"https://h{host}.example.org/{k}", source))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def measured(texts):
        right = sum(len(set(texts[i].split("\n")) & set(x)) for i, x in want.items())
        return right / sum(len(t.split("\n")) for t in texts.values()), right / sum(map(len, want.values()))

    alone = measured({i: host_paths.Page(source).extract(None) for i, _, source in rows})
    voted = measured({g.page_id: g.text for g in host_paths.extract(pages).collect()})
    assert min(voted) >= 0.9 and voted[1] >= alone[1] and voted[0] >= alone[0] - 0.02, (alone, voted)


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    from tickforge.llm import shared

    rows = [(i % 5, "https://big.example.org/" if i % 3 else "https://small.example.org/", page("<main>{}</main>") if i % 7 else None) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(tuple(g) for g in host_paths.extract(pages).collect())
    monkeypatch.setattr(host_paths, "MAX_BROADCAST", 0)
    monkeypatch.setattr(shared, "KEY_ROWS", 4)
    assert sorted(tuple(g) for g in host_paths.extract(pages).collect()) == want
