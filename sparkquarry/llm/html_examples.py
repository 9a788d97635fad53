"""The small labelled table that the block classifier is trained on: sketches of pages.

`{n}` stands for n words. Blocks whose text begins with § are main text, all others aren't.
"""

from __future__ import annotations

import random
import re
from itertools import product

NAV = "<nav><ul><li><a href=/>{1}</a></li><li><a href=/>{2}</a></li><li><a href=/>{1}</a></li></ul></nav>"
BARE_LINKS = "<div><a href=/>{1}</a> <a href=/>{2}</a> <a href=/>{1}</a></div><ul><li><a href=/>{3}</a></li><li><a href=/>{6}</a></li><li><a href=/>{1}</a></li></ul>"

PAGES = [
    # an article between menus, adverts and a footer
    NAV + "<div class=ad>{8}</div><article><h1>§{9}</h1><p>§{40}</p><p>§{1}</p><p>§{75}</p></article><footer>{7}</footer>",
    NAV + "<div class=ad>{3}</div><article><h1>§{1}</h1><p>§{2}</p></article><footer>{12}</footer>",
    NAV + "<div>{14}</div><article><h1>§{4}</h1><p>§{1}</p><p>§{3}</p><p>§{20}</p><p>§{1}</p></article><div>{9}</div><footer>{30} <a href=/>{2}</a></footer>",
    "<header><a href=/>{2}</a><p>{6}</p></header>" + NAV + "<main><h1>§{5}</h1><p>§{120}</p><h2>§{3}</h2><ul><li>§{4}</li><li>§{9}</li></ul><p>§{60}</p></main><aside><h3>{2}</h3><p>{35}</p></aside><footer>{5}</footer>",
    "<div class=cookie-notice><p>{25}</p><button>{1}</button></div><article><header><h1>§{7}</h1><p>{4}</p></header><p>§{30}</p><p>§{55}</p><footer>{6}</footer></article><div>{40}</div><p>{22}</p>",
    "<article><header><h1>§{3}</h1><p>§{45}</p><div>{3}</div></header><p>§{14}</p><aside>{50}</aside><p>§{6}</p><form>{3} <button>{2}</button></form><p>§{80}</p></article>",
    # an article with links of its own
    NAV + "<article><h1>§<a href=/>{6}</a></h1><p>§{20} <a href=/>{5}</a> {9}</p><p>§<a href=/>{4}</a></p><ul><li>§<a href=/>{3}</a> {12}</li><li>§<a href=/>{5}</a></li></ul><p>§{18}</p></article><div>{2}</div>",
    # comments of readers inside and outside
    "<article><h1>§{8}</h1><p>§{64}</p><section class=comments><h2>{2}</h2><article><p>{30}</p></article><article><p>{55}</p></article></section></article><footer>{4}</footer>",
    "<main><article><h1>§{5}</h1><p>§{33}</p></article><div id=comments><div class=comment><p>{45}</p></div><div class=comment><p>{3}</p></div></div></main><div class=related><a href=/>{8}</a><p>{16}</p></div>",
    # no landmarks, but names
    "<div id=header>{4}</div><div class=menu><a href=/>{1}</a><a href=/>{2}</a></div><div id=content><h1>§{6}</h1><p>§{50}</p><p>§{4}</p><p>§{90}</p></div><div class=sidebar><p>{30}</p></div><div id=footer>{12}</div>",
    "<div class=top-nav><a href=/>{2}</a></div><div class=post-body><h2>§{6}</h2><p>§{1}</p><p>§{28}</p></div><div class=newsletter><p>{18}</p><form><input>{2}</form></div>",
    # neither landmarks nor names: words and links of a block and its neighbours decide
    BARE_LINKS + "<div><h1>§{7}</h1><p>§{60}</p><p>§{45}</p><p>§{5}</p><p>§{80}</p></div><div><a href=/>{3}</a> {2}</div><div>{6}</div>",
    BARE_LINKS + "<table><tr><td><a href=/>{1}</a></td><td><h2>§{5}</h2><p>§{70}</p><p>§{31}</p></td></tr></table><div>{8}</div>",
    "<div>{3}</div><div>{2}</div><div><div><p>§{110}</p><p>§{95}</p><p>§{12}</p><p>§{66}</p></div></div><div>{5} <a href=/>{4}</a></div><ul><li><a href=/>{7}</a></li><li><a href=/>{9}</a></li></ul>",
    "<p>{4}</p>" + BARE_LINKS + "<div><p>§{38}</p><p>§{44}</p></div><ul><li><a href=/>{12}</a></li><li><a href=/>{15}</a></li></ul><div>{7}</div>",
    "<h1>§{6}</h1><p>§{52}</p><p>§{34}</p><p>§{71}</p><p><a href=/>{2}</a> <a href=/>{2}</a></p><p>{3}</p>",
    # nothing of an article
    NAV + "<div class=login><form>{4} <button>{2}</button></form></div><footer>{18}</footer>",
    NAV + "<div class=banner>{26}</div><ul><li><a href=/>{6}</a></li><li><a href=/>{8}</a></li></ul><footer>{9}</footer>",
]

#: Words of the main blocks, and of a block beside them, of the pages made by layouts().
BODIES = [body for k in (1, 2, 3) for body in product((1, 7, 50), repeat=k)] + [(5, 90, 2, 25, 55), (200,), (25, 25)]
BESIDE = [2, 20, 200]


def layouts() -> list[str]:
    """Pages in which an article or main element, a name or a place beside other text says what is main text, at all lengths."""
    out = []
    for body in BODIES:
        text = "".join(f"<p>§{{{n}}}</p>" for n in body)
        for n in BESIDE:
            out.append(f"{NAV}<div>{{{n}}}</div><article><h1>§{{{body[0]}}}</h1>{text}</article><div>{{{n}}}</div><footer>{{{n}}}</footer>")
            out.append(f"<div>{{{n}}}</div><main><h2>§{{{n % 9 + 1}}}</h2>{text}<div class=related><p>{{{n}}}</p></div></main><p>{{{n}}}</p>{BARE_LINKS}")
            out.append(f"<article><header><h1>§{{{n % 7 + 1}}}</h1><p>{{{n % 5 + 1}}}</p></header>{text}<section class=comments><p>{{{n}}}</p></section><aside><p>{{{n}}}</p></aside><form>{{{n}}}</form></article>")
            out.append(f"<p>{{{n}}}</p>{BARE_LINKS}<article><h2>§{{{n % 5 + 1}}}</h2>{text}</article>")
            out.append(f"{NAV}<article>{text}<p>§{{{n}}} <a href=/>{{{n % 7 + 1}}}</a></p><p>§{{{body[-1]}}}</p></article>")
            out.append(f"<div class=page-header><h1>{{{n % 6 + 1}}}</h1></div><div class=sidebar><p>{{{n}}}</p></div><div class=entry-content>{text}</div><div class=notice>{{{n}}}</div><div>{{{n}}}</div>")
        out.append(text)
        if sum(body) > 20:
            out.append(f"{BARE_LINKS}<div>{text}</div><div>{{2}}</div>")
            out.append(f"<table><tr><td><a href=/>{{1}}</a><a href=/>{{2}}</a></td><td><h1>§{{3}}</h1>{text}</td></tr></table><p>{{1}}</p>")
        for n in (1, 4, 12):  # all in one container: links tell
            out.append(f"<p><a href=/>{{1}}</a> <a href=/>{{{n}}}</a></p>{text}<p><a href=/>{{{n}}}</a> <a href=/>{{3}}</a></p><p>{{1}} <a href=/>{{{n}}}</a></p>")
            out.append(f"<p><a href=/>{{{n}}}</a></p><h1>§{{{n + 2}}}</h1>{text}<ul><li><a href=/>{{{n}}}</a></li><li><a href=/>{{{n + 9}}}</a></li></ul>")
    for n in range(1, 9):  # a page of one or two short blocks
        out += [f"<p>§{{{n}}}</p>"] * 2 + [f"<h1>§{{2}}</h1><p>§{{{n}}}</p>"] * 2
    return out


def mixtures(number: int = 250) -> list[str]:
    """Pages with an article of any blocks, linked or not, among other blocks of any kind, so that no length outweighs a landmark."""
    rng = random.Random(1)

    def some(mark: str) -> str:
        out = []
        for _ in range(rng.randint(1, 5)):
            n = rng.choice((1, 2, 5, 12, 40, 110))
            link = rng.choice(("", "", f" <a href=/>{{{rng.choice((1, 4))}}}</a>"))
            tag = rng.choice(("p", "p", "div", "li", "h2"))
            out.append(f"<{tag}>{mark}{{{n}}}{link}</{tag}>" if rng.random() < 0.9 else f"<{tag}>{mark}<a href=/>{{{n}}}</a></{tag}>")
        return "".join(out)

    return [f"{some('') * rng.randint(0, 1)}<article>{some('§')}</article>{some('') * rng.randint(0, 1)}" for _ in range(number)]


def pages() -> list[str]:
    """All sketches with words in them."""
    return [re.sub(r"\{(\d+)\}", lambda m: " ".join(f"word{i}" for i in range(int(m[1]))), page) for page in PAGES + layouts() + mixtures()]
