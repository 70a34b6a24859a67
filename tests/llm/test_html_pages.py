"""Main text of hand-made pages in many layouts: whole articles, and nothing else."""

import pytest

from recordcheck.llm import html

S = "The river rose for three days before the bridge was closed to all traffic in the valley."
T = "Nobody in the town remembered a spring as wet as this one, and the old men shook their heads."
U = "Engineers will look at the pillars next week, when the water has gone down again."
BAR = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport</a></li><li><a href=/d>About us</a></li></ul>"
FOOT = "<footer>&copy; 2024 The Paper. All rights reserved.</footer>"

PAGES = {
    "names of topics": (f"<body><nav>{BAR}</nav><div class='content' id='share-price-story'><h1>Flood</h1><p>{S}</p><p>{T}</p></div>{FOOT}", f"Flood\n{S}\n{T}"),
    "a topic alone": (f"<body><nav>{BAR}</nav><div id='search-engine-history'><h1>Flood</h1><p>{S}</p><p>{T}</p><p>{U}</p></div>{FOOT}", f"Flood\n{S}\n{T}\n{U}"),
    "side effects": (f"<body><div class='menu'>{BAR}</div><article id='side-effects-explained'><h1>Flood</h1><p>{S}</p><p>{T}</p></article>{FOOT}", f"Flood\n{S}\n{T}"),
    "plain element after a link bar": (f"<body><div><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>Sport</a></div><div>{' '.join([S, T, U] * 3)} {S}</div>", " ".join([S, T, U] * 3) + " " + S),
    "line breaks": (f"<body>{BAR}<div>{S}<br><br>{T}<br><br>{U}</div>{FOOT}", f"{S} {T} {U}"),
    "elements as paragraphs": (f"<body><div class='top-nav'>{BAR}</div><div class='x'><h1>Flood</h1><div>{S}</div><div>{T}</div><div>{U}</div></div>{FOOT}", f"Flood\n{S}\n{T}\n{U}"),
    "noscript and xmp": (f"<body><nav>{BAR}</nav><article><h1>Flood</h1><p>{S}</p><noscript><p>{T}</p></noscript><xmp>if a < b &amp; c: <b>x</b></xmp><p>{U}</p></article>{FOOT}", f"Flood\n{S}\n{T}\nif a < b &amp; c: <b>x</b>\n{U}"),
    "noscript of the page": (f"<body><noscript><p>Please turn on scripts to use this page in full.</p></noscript><nav>{BAR}</nav><main><h1>Flood</h1><p>{S}</p><p>{T}</p></main>{FOOT}", f"Flood\n{S}\n{T}"),
    "reader comments": (f"<body><nav>{BAR}</nav><article><h1>Flood</h1><p>{S}</p><p>{T}</p></article><section class='user-comments'><div class='c'><p>{U}</p></div><div class='c'><p>{S}</p></div></section>{FOOT}", f"Flood\n{S}\n{T}"),
    "sidebar and advert": (f"<body><div class='wrap'><div class='main-column'><h2>Flood</h2><p>{S}</p><div class='ad-slot'>Buy two boats and get one free today only.</div><p>{T}</p></div><div class='sidebar-left'><h3>More</h3><p>{U}</p></div></div>{FOOT}", f"Flood\n{S}\n{T}"),
    "cookie bar": (f"<body><div class='cookie-bar'><p>We use cookies to make this site better for all of its readers.</p></div><nav>{BAR}</nav><main><h1>Flood</h1><p>{S}</p><ul><li>The bridge</li><li>The mill.</li></ul><p>{T}</p></main>{FOOT}", f"Flood\n{S}\nThe bridge\nThe mill.\n{T}"),
    "old tables": (f"<body><table><tr><td><a href=/a>Home</a><br><a href=/b>News</a></td><td><h1>Flood</h1><p>{S}</p><p>{T}</p><p>{U}</p></td></tr></table>{FOOT}", f"Flood\n{S}\n{T}\n{U}"),
    "nothing but menus": (f"<body><nav>{BAR}</nav>{FOOT}", ""),
}


@pytest.fixture(scope="module")
def tree():
    return html.train_tree()


@pytest.mark.parametrize("name", PAGES)
def test_page(tree, name):
    page, want = PAGES[name]
    assert html.main_text(page, tree) == want


@pytest.mark.parametrize(
    "name, mark", [("content", 2), ("share-price-story", 2), ("share-price", -1), ("comment-list", -2), ("post-comments", -2), ("main-nav", -2), ("sideEffects", -1), ("article-body-inner", 2), ("x1", 0), ("", 0), ("list", 0), ("contentWrapper", 2)]
)
def test_names(name, mark):
    assert html.name_mark(name) == mark


def test_names_outweigh_each_other():
    assert html.marks("div", " class='content share'") == 0 and html.marks("div", " class='content' id='share-price-story'") == 2
    assert html.marks("article", " class='ad'") == 2 and html.marks("article", " hidden") == -2 and html.marks("nav", " class='main'") == -2
