"""Furniture by compound names and by tags, of any length, around articles that the page marks or doesn't."""

import random

import pytest

from auditarium.llm.html_extraction import main_text

NAMES = "cookie-banner cookie-notice cookie-consent site-footer left-sidebar sidebar-left comment-list comments-area nav-main newsletter-signup related-posts ad-slot alert-box promo-box cookieBanner sidebar comments cookies".split()


def sentences(rng, n):
    out = ""
    while len(out) < n:
        out += " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 14))).capitalize() + rng.choice((". ", ", "))
    return out[:n].strip()


@pytest.mark.parametrize("name", NAMES)
def test_compound_names(name):
    rng = random.Random(name)
    for n in (200, 500, 1000):
        for where in ("before", "after", "both"):
            for around in ("<article>{}</article>", "<div class='post'>{}</div>", "<main><div>{}</div></main>"):
                paragraphs = [sentences(rng, rng.randint(150, 400)) for _ in range(4)]
                body = around.format("<h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs))
                side = f"<div class='{name}'><p>{sentences(rng, n)}</p></div>"
                assert main_text(f"<html><body>{side if where != 'after' else ''}{body}{side if where != 'before' else ''}</body></html>") == " ".join(["Title of it", *paragraphs]), (n, where, around)


def test_names_of_content_and_layout_stay():
    rng = random.Random(1)
    paragraphs = [sentences(rng, 300) for _ in range(4)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    for name in ("has-sidebar", "content-sidebar-wrap", "entry-header-content", "with-comments"):
        assert main_text(f"<body><div class='{name}'>{body}</div><p>short</p></body>").startswith(" ".join(paragraphs)), name


def test_pages_in_furniture_tags():
    rng = random.Random(2)
    paragraphs = [sentences(rng, 300) for _ in range(4)]
    body, want = "<h1>T</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs), " ".join(["T", *paragraphs])
    for page in (
        f"<body><form action=x><div>{body}</div></form></body>",
        f"<body><nav><a href=x>Home</a> <a href=y>More</a>{body}</body>",
        f"<body><form><nav><a href=a>A a</a></nav><div id=main>{body}</div><footer>All rights reserved</footer></form></body>",
        f"<body><div>{body}</div><aside><p>{sentences(rng, 900)}</p></aside></body>",
        f"<body><article>{body}</article><form><p>{sentences(rng, 2500)}</p></form></body>",
        f"<body><nav><h1>Site</h1><p>menu</p></nav><article>{body}</article><footer><p>{sentences(rng, 2000)}</p></footer></body>",
    ):
        assert main_text(page) == want
    assert main_text("<p>Few words here.</p><footer>© somebody, of many more words than the page itself has to say about it.</footer>") == "Few words here."
    assert main_text(f"<form><p>{paragraphs[0]}</p></form>") == paragraphs[0]
