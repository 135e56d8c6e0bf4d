"""Pages of many builds, labelled by hand: every character of the article, and next to none of the rest."""

import pytest

from quillspark.llm.html_crf import labelled_pages, leaf_blocks, main_text, train

A = "The harbour was quiet when the first boats came in, and nobody on the quay had slept."
B = "They had been out for nine days. The nets were torn, the ice had melted, and the radio was dead."
C = "What the owners wanted to know was simple: who would pay for the fuel, and when."
D = "By noon the fish was sold. Not all of it, and not at a good price, but sold it was."
E = "A week later the same boats left again."
P = "".join(f"<p>{x}</p>" for x in (A, B, C, D))
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2026 The Quay &middot; All rights reserved</p></footer>"
FULL = [A, B, C, D]

PAGES = {
    "section in body": (f"<html><head><title>t</title></head><body>{NAV}<section>{P}</section>{FOOT}</body></html>", FULL),
    "section in main": (f"<body>{NAV}<main><section><h1>Boats</h1>{P}</section></main>{FOOT}", ["Boats", *FULL]),
    "chapters": (f'{NAV}<div id="content"><section class="chapter"><h2>One</h2><p>{A}</p><p>{B}</p></section><section class="chapter"><h2>Two</h2><p>{C}</p><p>{D}</p></section></div>{FOOT}', ["One", A, B, "Two", C, D]),
    "sections of an article": (f"<article><h1>Boats</h1><section><h2>Out</h2><p>{A}</p><p>{B}</p></section><section><h2>In</h2><p>{C}</p><p>{D}</p></section></article>{FOOT}", ["Boats", "Out", A, B, "In", C, D]),
    "comments in a section": (f'<article><h1>Boats</h1>{P}</article><section class="comments"><h3>2 comments</h3><p>I was there and it was not like that at all.</p><p>Nice!</p></section>{FOOT}', ["Boats", *FULL]),
    "comments beside a plain div": (f'<body><div><h1>Boats</h1>{P}</div><div class="comments"><p>He is wrong here, I think.</p><p>Thank you for this one!</p></div></body>', ["Boats", *FULL]),
    "aside inside": (f"<article><h1>Boats</h1><p>{A}</p><p>{B}</p><aside><h4>More</h4><p>Ten boats to see</p></aside><p>{C}</p><p>{D}</p></article>", ["Boats", *FULL]),
    "advert inside": (f'<main><h1>Boats</h1><p>{A}</p><div class="ad">Buy now</div><p>{B}</p><div class="sponsored"><p>Ropes from <a href="/x">Rope & Co</a></p></div><p>{C}</p><p>{D}</p></main>', ["Boats", *FULL]),
    "newsletter inside": (f'<div class="post"><h1>Boats</h1><p>{A}</p><p>{B}</p><form class="newsletter"><label>Your mail</label><input><button>Send</button></form><p>{C}</p></div>{FOOT}', ["Boats", A, B, C]),
    "one paragraph after html": (f"<html><p>{A} {B} {C}</p>", [f"{A} {B} {C}"]),
    "one paragraph": (f"<p>{A} {B}</p>", [f"{A} {B}"]),
    "a formula": (f"<article><h1>Boats</h1><p>The power is <math><mi>P</mi><mo>=</mo><mi>F</mi><mi>v</mi></math> as we all know.</p><p>{B}</p></article>", ["Boats", "The power is P=Fv as we all know.", B]),
    "an object's text": (f"<main><p>{A}</p><p>The film <object data=f.mp4>of the boats</object> was lost.</p><p>{B}</p></main>", [A, "The film of the boats was lost.", B]),
    "an open drawing": (f"<article><h1>Boats</h1><p>{A}</p><svg viewBox='0 0 1 1'><p>{B}</p><p>{C}</p></article>", ["Boats", A, B, C]),
    "an open list of choices": (f"<article><h1>Boats</h1><p>{A}</p><select><p>{B}</p><p>{C}</p><p>{D}</p></article>", ["Boats", *FULL]),
    "quotes, lists, captions": (f"{NAV}<article><h1>Boats</h1><p>{A}</p><blockquote>{B}</blockquote><ul><li>Nets</li><li>Ice and salt</li></ul><figure><img src=a><figcaption>The quay at six.</figcaption></figure><p>{C}</p></article>", ["Boats", A, B, "Nets", "Ice and salt", "The quay at six.", C]),
    "a table": (f"<main><h1>Boats</h1><p>{A}</p><table><tr><th>Fish</th><th>Price</th></tr><tr><td>Cod</td><td>Too low.</td></tr></table><p>{B}</p></main>", ["Boats", A, "Fish", "Price", "Cod", "Too low.", B]),
    "divs for paragraphs": (f'<div class="wrapper"><div class="header"><a href="/">The Quay</a></div><div class="content"><h1>Boats</h1><div>{A}</div><div>{B}</div><div>{C}</div></div><div class="sidebar"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div class="footer">&copy; 2026 Quay</div></div>', ["Boats", A, B, C]),
    "main around an article": (f'<header class="masthead"><h1>The Quay</h1></header>{NAV}<main><article><h1>Boats</h1>{P}</article><aside class="related"><ul><li><a href="/a">Cod</a></li><li><a href="/b">Ice</a></li></ul></aside></main>{FOOT}', ["Boats", *FULL]),
    "cookies first": (f'<div class="cookie-notice"><p>We use cookies to make this site better.</p><button>Accept</button></div>{NAV}<section id="main"><h1>Boats</h1>{P}<p>{E}</p></section>{FOOT}', ["Boats", *FULL, E]),
    "links in a text": (f'<article><h1>Boats</h1><p>{A} See <a href="/q">the quay</a> for more.</p><p>{B}</p></article><div class="share"><a href="/f">Share</a></div>', ["Boats", f"{A} See the quay for more.", B]),
    "an open script": (f"<article><h1>Boats</h1><p>{A}</p><p>{B}</p></article><script>var x = '<p>no text</p>'", ["Boats", A, B]),
    "no tags": ("Just a line of text that has no tags at all around it.", ["Just a line of text that has no tags at all around it."]),
}


@pytest.fixture(scope="module")
def field():
    return train()


@pytest.mark.parametrize("name", PAGES)
def test_articles_are_kept(field, name):
    page, want = PAGES[name]
    got = main_text(page, field).split("\n")
    held = sum(len(x) for x in want if x in got)
    assert held >= 0.95 * sum(map(len, want)), got
    assert sum(len(x) for x in got if x not in want) <= 0.05 * sum(map(len, want)), got


def test_tags_around_everything_change_nothing(field):
    for page, _ in PAGES.values():
        bare = page.replace("<html>", "").replace("<body>", "").replace("</body>", "").replace("</html>", "").replace("<head><title>t</title></head>", "")
        assert main_text(f"<html><body>{bare}</body></html>", field) == main_text(bare, field)


def test_pages_not_seen_in_training(field):
    right = wrong = 0
    for page, labels in labelled_pages(150, seed=1234):
        kept = main_text(page, field).split("\n")
        want = [b.text for b, y in zip(leaf_blocks(page), labels, strict=True) if y]
        right += sum(len(x) for x in want if x in kept)
        wrong += sum(len(x) for x in want if x not in kept) + sum(len(x) for x in kept if x not in want)
    assert wrong < 0.02 * right
