"""Pages without an element that says which part is the article, and held-out pages of all random layouts."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from tessera.llm import html_text

TEXT = "The river rose by two metres in the night and flooded the lower part of the old town before anybody could be warned of it, said the mayor."
FOUR = "Four people were taken to hospital, and the bridge stays closed until engineers have looked at its piers."
CASES = {
    "body": (f"<html><body>{TEXT}</body></html>", TEXT),
    "breaks": (f"<body><div>{TEXT}<br><br>{FOUR}</div></body>", f"{TEXT} {FOUR}"),
    "font": (f"<body><center><font size=3>{TEXT}</font></center></body>", TEXT),
    "title and div": (f"<body><h1>Flood</h1><div>{TEXT}</div></body>", f"Flood {TEXT}"),
    "no markup": (TEXT, TEXT),
    "short": ("<p>Hello there.</p>", "Hello there."),
    "thread": (f"<article><p>{TEXT}</p><ol class='thread'><li>Great post, thanks!</li><li>I disagree with this.</li></ol></article>", TEXT),
    "layout table": (f"<table><tr><td><a href=1>Home</a><a href=2>News</a><a href=3>Sport</a></td><td>{TEXT}</td></tr></table>", TEXT),
    "layout table with breaks": (f"<body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><p>{TEXT}</p><p>{FOUR}</p></td></tr></table></body>", f"{TEXT} {FOUR}"),
    "plain divs": (f"<body><div><div><span>{TEXT}</span></div><div>{FOUR}</div></div><div class=footer>Imprint</div></body>", f"{TEXT} {FOUR}"),
    "rule": (f"<body>{TEXT}<hr><a href=/>Home</a> | <a href=/n>News</a></body>", TEXT),
    "nothing": ("<body><nav><a href=1>Home</a></nav><footer>&copy; Us</footer></body>", ""),
    "furniture only": ("<body><form><label>Find</label><input></form><div class=cookie-banner>We use cookies.</div></body>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_articles_without_a_frame(name):
    page, want = CASES[name]
    assert html_text.extract(page, html_text.fitted()) == want


def test_held_out_layouts():
    """Precision and recall in words over random pages that the model hasn't seen; the loose ones apart."""
    counts = {True: Counter(), False: Counter()}
    for i, page in enumerate(html_text.training_pages(600, seed=99)):
        nodes = html_text.parse(page, labelled=True)
        want = Counter(" ".join(x.text for x in nodes if x.text is not None and x.label).split())
        plain = re.sub(r' data-keep="\d"|<!--/?keep-->', "", page)
        got = Counter(html_text.extract(plain, html_text.fitted()).split())
        counts[i % html_text.LOOSE == 0].update(hit=(want & got).total(), kept=got.total(), there=want.total(), empty=int(bool(want) and not got))
    for loose, c in counts.items():
        print("loose" if loose else "framed", round(c["hit"] / c["kept"], 4), round(c["hit"] / c["there"], 4), c["empty"])
        assert c["hit"] >= 0.95 * c["kept"] and c["hit"] >= 0.95 * c["there"] and not c["empty"], (loose, c)


def test_the_last_resort_reads_no_furniture():
    nodes = html_text.parse(f"<body><nav><a href=1>Home</a></nav><div>{TEXT}<ul class=menu><li>Sport</li></ul></div><p><a href=x>All the news</a></p><footer>Us</footer></body>")
    assert html_text.unplaced(nodes) == [TEXT]
