"""Nearest-URL page differencing against a plain version over all paths of small hosts."""

import random

from matchlab.llm import pagetext


def texts(spark, pages):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pagetext.main_text(df).collect()}
    return [got[k] for k in range(len(pages))]


def plain_text(page, other):
    """The deletion by a table of lengths, one cell for each pair of lines."""
    lines, zones, slots = pagetext.page_blocks(page)
    a, slot = pagetext.identities(lines, zones, slots)
    b = pagetext.identities(*pagetext.page_blocks(other))[0] if other is not None else a
    same, compared = set(), bool(b) and a != b
    if compared:
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                same.add(i)
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        template = {a[i] for i in same if slot[i]}
        same |= {i for i, x in enumerate(a) if x in template}
    out = []
    for i, (line, zone) in enumerate(zip(lines, zones)):
        if zone == pagetext.ARTICLE or zone == pagetext.PLAIN and i not in same or zone == pagetext.NAMED and compared and i not in same:
            out.append(line)
    return "\n".join(out)


def plain_partner(paths, pages, me):
    """The page that ``me`` is compared with: every path of the host is looked at in turn."""
    order = sorted(range(len(paths)), key=lambda k: paths[k].encode())
    parsed = {}
    for k in order:
        blocks = pagetext.page_blocks(pages[k])
        ids, slot = pagetext.identities(*blocks)
        parsed[k] = ids, [0 if z == pagetext.OUT or s else len(x) for x, z, s in zip(blocks[0], blocks[1], slot)]
    at = order.index(me)

    def alike(i):
        return pagetext.share(*parsed[order[i]], *parsed[order[i + 1]])

    def prefix(i):
        n = 0
        for x, y in zip(paths[me], paths[order[i]]):
            if x != y:
                break
            n += 1
        return n
    found = []
    if at + 1 < len(order) and pagetext.COPY <= alike(at) <= pagetext.ONLY_COPY:
        found.append((0, prefix(at + 1), 0, at + 1))
    if at and pagetext.COPY <= alike(at - 1) <= pagetext.ONLY_COPY:
        found.append((0, prefix(at - 1), 1, at - 1))
    for i in range(at, len(order) - 1):
        if alike(i) < pagetext.COPY:
            found.append((1, prefix(i + 1), 0, i + 1))
            break
    for i in range(at - 1, -1, -1):
        if alike(i) < pagetext.COPY:
            found.append((1, prefix(i), 1, i))
            break
    return pages[order[max(found)[3]]] if found else None


def some_page(rng, story, day):
    """Template lines in one order, each left out at times; the story's lines; the article marked or not."""
    def word():
        return "".join(rng.choice("aeioustr") for _ in range(9))
    body = "".join(f"<p>story {story} line {i} tells of {story * 31 + i}</p>" for i in range(rng.randrange(3, 6))) + f"<p>day {day}</p>"
    body += rng.choice(["", f'<div class="share-buttons"><p>{word()}</p></div>', f'<p class="share-price">{word()}</p>'])
    parts = ["<div>Site name</div>", f"<nav><ul>{''.join(f'<li>{word()}</li>' for _ in range(rng.randrange(4)))}</ul></nav>", "<div>Today</div>",
             f'<div class="teaser-box">{word()}</div>', f'<div id="ad-{rng.randrange(99)}">{word()}</div>', f"<p>{word()}</p>", "<div>Imprint</div>",
             f"<footer>{word()}</footer>"]
    wrap = rng.choice(["<article>{}</article>", "<div>{}</div>"]).format(body)
    parts = [x for x in parts if rng.random() < 0.8]
    cut = rng.randrange(len(parts) + 1)
    return "<html><body>" + "".join(parts[:cut]) + wrap + "".join(parts[cut:]) + "</body></html>"


def test_pairing_and_deletion_equal_a_plain_version(spark):
    rng = random.Random(11)
    pages, want = [], []
    for h in range(12):
        paths = sorted({"/" + "/".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 14))})
        rng.shuffle(paths)
        htmls = [some_page(rng, rng.randrange(3), k % 4) for k in range(len(paths))]
        pages += [(f"https://Host{h}.example:80{p}{rng.choice(['', '/', '?q=1', '#x'])}", t) for p, t in zip(paths, htmls)]
        want += [plain_text(t, plain_partner(paths, htmls, k)) for k, t in enumerate(htmls)]
    assert [r.text for r in texts(spark, pages)] == want


def test_slots_of_other_words_are_shared(spark):
    page = ('<nav><a>{0} one</a></nav><div class="teaser">see {0}</div><article><h1>{0}</h1><p>all that {0} is and was</p>'
            '<section id="social-history"><p>history of {0}</p></section><p class="share-price">price of {0}</p><div class="related-work"><p>work on {0}</p></div>'
            '<div class="share-buttons">send {0}</div><div class="comment-list"><p>{0}!</p></div></article><div id="box7">more of {0}</div><footer>{0}</footer>')
    got = texts(spark, [(f"http://a.example/{x}", page.format(x)) for x in ("oak", "elm")] + [("http://b.example/x", page.format("ash"))])
    for r, x in zip(got, ("oak", "elm", "ash")):
        body = f"{x}\nall that {x} is and was\nhistory of {x}\nprice of {x}\nwork on {x}"
        if x == "ash":  # no neighbour: rules alone
            assert r.text == f"see {x}\n{body}\nmore of {x}" and (r.n_shared, r.n_deleted, r.n_ruled) == (0, 0, 4)
        else:  # the id of an unshared section is its own place; the names of article parts don't delete them
            assert r.text == body and (r.n_deleted, r.n_ruled) == (6, 0)


def test_a_teaser_marked_as_article_protects_the_body(spark):
    page = '<div class="content"><p>the body says {0} and a lot more of {0}</p></div><article class="teaser"><p>{0}</p></article><div>Imprint</div>'
    got = texts(spark, [(f"http://a.example/{x}", page.format(x)) for x in ("oak", "elm")])
    assert [r.text for r in got] == [f"the body says {x} and a lot more of {x}\n{x}" for x in ("oak", "elm")]


def test_very_long_pages_and_lines(spark):
    rows = [f"<p>line {k} of {{0}}</p>" for k in range(3000)]
    page = "<div>Site</div>" + "".join(rows) + "<p>" + "{0} " * 100_000 + "</p><div>Imprint</div>"
    got = texts(spark, [(f"http://a.example/{x}", page.format(x)) for x in ("oak", "elm")])
    for r, x in zip(got, ("oak", "elm")):
        assert r.text == "\n".join(f"line {k} of {x}" for k in range(3000)) + "\n" + " ".join([x] * 100_000)
