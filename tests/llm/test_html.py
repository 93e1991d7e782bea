"""HTML extraction: regions that names make suspect, the wrapper's say, alignment of long pages."""

import random
import time

import pytest

from sparkloom.llm import wrappers

STORY = "<p>the first paragraph of a story that goes on for a while</p><p>and the second one, which ends it</p>"
TEXT = "the first paragraph of a story that goes on for a while\n\nand the second one, which ends it"


def alone(source, whole=True):
    page = wrappers.parse(source)
    return "\n\n".join(wrappers.blocks(page, wrappers.pattern(page), whole))


@pytest.mark.parametrize(
    "source",
    [
        f'<div class="page no-sidebar"><div class="content">{STORY}</div></div>',
        f'<div id="main" class="has-header">{STORY}</div>',
        f'<div class="page no-sidebar"><article>{STORY}</article><article class="comment">a reply</article></div>',
        f'<div class="sidebar-wrapper">{STORY}</div><p class="copyright">all rights</p><div class="comments"><p>{"long reply " * 50}</p></div>',
        f'<div class="ad">buy<article>{STORY}</article>',
        f'<div class="widget">{STORY}</div>',
        f'<article>{STORY}</article><div class="related"><article>teaser one</article><article>teaser two</article></div>',
        f'<section id="comments"><article>first reply</article><article>second</article></section><article>{STORY}</article>',
    ],
)
def test_no_article_is_lost_with_its_surroundings(source):
    assert alone(source) == TEXT


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<p class="related-work">kept</p>', "kept"),
        ('<p class="notice-of-death">kept</p>', "kept"),
        ('<div class="form-of-address">kept</div>', "kept"),
        ('<p>a <span class="search">kept</span> word</p>', "a kept word"),
        ("<header><h1>Title</h1></header>", "Title"),
        ('<div class="share-buttons">Tweet</div>', ""),
        ('<div class="ad">Buy</div>', ""),
        ("<aside>beside</aside><nav>menu</nav><form>name</form><script>x</script>", ""),
        ('<ul class="related-reading"><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>', ""),  # links: the pattern tells
        ('<div hidden>hidden</div><p style="display: none">gone</p><p role="alert">alert</p>', ""),
    ],
)
@pytest.mark.parametrize("whole", [True, False])
def test_regions_inside_a_marked_article(inside, text, whole):
    assert alone(f"<nav>menu</nav><article>{inside}{STORY}</article>", whole) == "\n\n".join(filter(None, [text, TEXT]))


def test_comments_go_whatever_their_length():
    assert alone(f'{STORY}<div class="comment-list"><p>{"reply " * 100}</p></div>') == TEXT
    assert alone('<div id="comments"><p>only replies here</p></div>') == ""


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    return [r.text for r in wrappers.extract(df, whole_articles=True).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [2, 4, 6, 9])
def test_what_all_pages_share_is_the_template(spark, n):
    page = '<h1>The Daily</h1><div class="message-of-notice">read our terms</div><div>{}</div>'
    texts = [f"a story of day {i} with words enough to be the greater part of its page" for i in range(n)]
    assert extracted(spark, [page.format(t) for t in texts]) == texts
    versions = [f"<p>{TEXT}</p><p>edited {i}</p>" for i in range(n)]  # of one article: what they share is it
    assert extracted(spark, versions) == [f"{TEXT.replace(chr(10), ' ').replace('  ', ' ')}\n\nedited {i}" for i in range(n)]


def test_a_suspect_part_that_some_pages_lack(spark):
    extra = '<div class="further-promo"><p>offer {0}</p><p>price {0}</p></div>'
    pages = [f"<div><p>one {i} story</p><p>two {i} story</p><p>three {i}</p></div>" + (extra.format(i) if i % 2 else "") for i in range(6)]
    assert extracted(spark, pages) == [f"one {i} story\n\ntwo {i} story\n\nthree {i}" for i in range(6)]
    assert extracted(spark, pages[1:2]) == ["one 1 story\n\ntwo 1 story\n\nthree 1\n\noffer 1\n\nprice 1"]  # one page tells nothing


def test_alignment_of_many_different_siblings():
    def page(names):
        return wrappers.parse("<section>" + "".join(f'<div class="{n}">{n}</div>' for n in names) + "</section>")

    letters = "abcdefghij"
    name = lambda i: "x" + "".join(letters[int(c)] for c in str(i))
    one, two = page([name(i) for i in range(20_000)]), page([name(i) for i in range(10_000, 30_000)])
    began = time.time()
    whole = wrappers.merge(wrappers.pattern(one), wrappers.pattern(two))
    inside = whole[3][0][3]
    assert len(inside) == 30_000
    found = wrappers.align(two.children[0].children, inside)
    assert [n[0] for n in found] == [c.sig for c in two.children[0].children]
    assert time.time() - began < 20


def covers(nodes, children):
    """All ways to run a pattern over children, by trying them: whether there is one."""
    todo = [(0, 0, False)]
    seen = set()
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        i, k, used = state
        if i == len(nodes):
            if k == len(children):
                return True
            continue
        if used or nodes[i][1] in "?*":
            todo.append((i + 1, k, False))
        if k < len(children) and (not used or nodes[i][1] in "+*"):
            c = children[k]
            text = isinstance(c, wrappers.Text)
            if (text and nodes[i][0] == "#" and nodes[i][3] in (None, c.text)) or (not text and nodes[i][0] == c.sig and covers(nodes[i][3], c.children)):
                todo.append((i, k + 1, True))
    return False


@pytest.mark.parametrize("seed", range(30))
def test_a_host_pattern_covers_each_of_its_pages(seed):
    r = random.Random(seed)

    def some(depth):
        return "".join(r.choice(["text%d" % r.randrange(3), f"<{(t := r.choice(['div', 'p', 'ul']))}>{some(depth - 1) if depth else 'x'}</{t}>"]) for _ in range(r.randrange(5)))

    pages = [wrappers.parse(some(2)) for _ in range(4)]
    whole = None
    for p in map(wrappers.pattern, pages):
        whole = p if whole is None else wrappers.merge(whole, p)
    for p in pages:
        assert covers(whole[3], p.children)
        assert None not in wrappers.align(p.children, whole[3])
