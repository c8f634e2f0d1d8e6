"""Labelled pages to train the block CRF on: varied layouts with known main text.

Every piece of text is unique, so a label is kept by text.  Layouts differ in where
the main text stands (article, main, a div with a telling class, plain body) and in
what surrounds it: menus, headers, side columns, notices, adverts, forms, reader
comments, footers, also such parts inside the article.
"""

from __future__ import annotations

import random

WORDS = "alder basin cobble drift ember fallow gravel harbor inlet juniper kettle lumen meadow nimbus orchard pebble quartz ridge saddle thicket umber vessel willow yarrow".split()
#: Words that sites use in class and id values, by the part they mark.
PARTS = {
    "nav": "nav menu navbar breadcrumb breadcrumbs toc pagination tabs".split(),
    "header": "header masthead banner topbar branding logo".split(),
    "footer": "footer copyright legal bottom colophon".split(),
    "aside": "sidebar aside related widget recommended trending newsletter popular".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "notice": "cookie notice consent alert popup modal gdpr subscribe".split(),
    "comments": "comments comment disqus replies responses discussion".split(),
    "share": "share social toolbar buttons follow".split(),
    "form": "form search login signup subscribe".split(),
}
MAIN = "content article post entry main story body text".split()
#: Class values that say nothing of what is within: they stand around main text and around all else.
LAYOUT = "row col container wrapper wrap inner outer box grid group block module section region panel cell flex stack unit holder page site column c1 x2 css".split()


def labelled_pages(count: int, seed: int, levels: tuple[int, int] = (1, 3), apart: bool = False):
    """(markup, {text: label}) of ``count`` pages.

    Wrappers (div, section; with layout classes or none) stand around anything, ``levels`` of them.  With
    ``apart`` the main text has layouts that it has not without: sections within sections, lists and
    figures in wrappers, main text in divs that are siblings of one another, headings of their own wrapper.
    """
    rng = random.Random(seed)
    for number in range(count):
        labels: dict[str, int] = {}
        wrapped = rng.random() < 0.6  # this site is fond of wrappers

        def text(label: int, low: int, high: int, end: str = ".", number=number, labels=labels) -> str:
            words = [rng.choice(WORDS) for _ in range(rng.randint(low, high))]
            said = f"{' '.join(words).capitalize()} {number} {len(labels)}{end}"
            labels[said] = label
            return said

        def wrap(inner: str, chance: float = 0.3, wrapped=wrapped) -> str:
            if wrapped and rng.random() < chance:
                for _ in range(rng.randint(*levels)):
                    tag = rng.choice(["div", "div", "div", "section"])
                    said = f' {rng.choice(["class", "id"])}="{" ".join(rng.sample(LAYOUT, rng.randint(1, 2)))}"' if rng.random() < 0.6 else ""
                    inner = f"<{tag}{said}>{inner}</{tag}>"
            return inner

        def menu() -> str:
            return "<ul>" + "".join(f'<li><a href="/x">{text(0, 1, 3, "")}</a></li>' for _ in range(rng.randint(3, 8))) + "</ul>"

        def part(kind: str) -> str:
            word = rng.choice(PARTS[kind])
            mark = f' {rng.choice(["class", "id"])}="{word}"' if rng.random() < 0.8 else ""
            mark = mark or (f' class="{word}"' if kind in ("ad", "notice", "comments", "share") else "")
            if kind == "nav":
                return f"<nav{mark}>{wrap(menu())}</nav>" if rng.random() < 0.7 else f'<div class="{word}">{wrap(menu())}</div>'
            if kind == "header":
                return f"<header{mark}>{wrap(f'<p>{text(0, 1, 6, '')}</p>')}{menu() if rng.random() < 0.4 else ''}</header>"
            if kind == "footer":
                said = f"© {text(0, 2, 15)}"
                labels[said] = 0
                return f"<footer{mark}>{said}</footer>" if rng.random() < 0.5 else f"<footer{mark}>{wrap(f'<p>{said}</p>', 0.7)}</footer>" if rng.random() < 0.4 else f'<div class="{word}"><p>{said}</p></div>'
            if kind == "aside":
                body = wrap(f"<h3>{text(0, 1, 4, '')}</h3>" + wrap(f"<p>{text(0, 4, 40)}</p>"))
                return f"<aside{mark}>{body}</aside>" if rng.random() < 0.7 else f'<div class="{word}">{body}</div>'
            if kind == "form":
                return f"<form{mark}>{wrap(f'<p>{text(0, 2, 12)}</p>')}<button>{text(0, 1, 2, '')}</button><label>{text(0, 1, 3, '')}</label></form>"
            if kind == "comments":
                tag = rng.choice(["div", "section"])
                body = "".join(wrap(f"<p>{text(0, 3, 60)}</p>") if rng.random() < 0.6 else f'<div class="comment"><p>{text(0, 3, 60)}</p></div>' for _ in range(rng.randint(1, 5)))
                return f"<{tag}{mark}><h3>{text(0, 1, 3, '')}</h3>{wrap(body)}</{tag}>"
            inner = text(0, 2, 30)
            return f"<div{mark}>{inner}</div>" if rng.random() < 0.5 else f"<div{mark}>{wrap(f'<p>{inner}</p>')}</div>"

        def piece() -> str:
            kind = rng.random()
            if apart and kind < 0.25:
                inner = f"<h2>{text(1, 1, 6, '')}</h2><section><p>{text(1, 2, 40)}</p><section><div>{text(1, 2, 30)}</div><p>{text(1, 1, 30)}</p></section></section>"
                return f"<section>{inner}</section>" if rng.random() < 0.5 else f"<figure><div><p>{text(1, 2, 20)}</p></div><figcaption>{text(1, 1, 8)}</figcaption></figure>"
            if kind < 0.6:
                return f"<p>{text(1, 1, 90)}</p>" if rng.random() < 0.7 else f"<p>{text(1, 1, 20, '')}<br>\n" if rng.random() < 0.3 else f"<p><b>{text(1, 1, 40)}<br>"
            if kind < 0.7:
                return f"<h2>{text(1, 1, 6, '')}</h2><p>{text(1, 3, 60)}</p>"
            if kind < 0.78:
                return "<ul>" + "".join(f"<li>{text(1, 2, 20)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            if kind < 0.84:
                return f"<blockquote>{wrap(text(1, 3, 30), 0.5)}</blockquote>"
            if kind < 0.9:
                return f"<table><tr><td>{text(1, 1, 6)}</td><td>{text(1, 1, 6)}</td></tr></table>"
            return f"<div>{text(1, 2, 60)}</div>" if rng.random() < 0.5 else f"<p>{text(1, 2, 40)}</p>"

        def body() -> str:
            title = f"<h1>{text(1, 2, 10, rng.choice(['', '.', '!']))}</h1>"
            out = [wrap(title, 0.3)] if rng.random() < 0.8 else []
            run: list[str] = []
            for _ in range(rng.randint(1, 9) if rng.random() < 0.85 else 1):
                run.append(wrap(piece(), 0.25))
                if rng.random() < 0.12:
                    run.append(part(rng.choice(["ad", "share", "form", "aside", "notice"])))
            half = len(run) // 2
            out += [wrap("".join(run[:half]), 0.4), wrap("".join(run[half:]), 0.4)] if rng.random() < 0.5 else [wrap("".join(run), 0.7)]
            if not out[0].startswith("<h1") and title not in out and rng.random() < 0.3 and not any("<h1" in x for x in out):
                out.append(f"<h1>{text(1, 2, 10, '')}</h1><p>{text(1, 3, 30)}</p>")  # a title that does not come first
            if rng.random() < 0.15:
                out.append(part("comments"))
            return "".join(out)

        before = [part(k) for k in ("notice", "header", "nav", "ad") if rng.random() < 0.6]
        after = [part(k) for k in ("comments", "aside", "form", "share", "ad", "footer") if rng.random() < 0.5]
        shape = rng.random()
        if shape < 0.4:
            core = f"<article>{body()}</article>"
        elif shape < 0.55:
            core = f"<main>{wrap(body(), 0.5)}</main>"
        elif shape < 0.65:
            core = f'<main><article class="{rng.choice(MAIN)}">{body()}</article></main>'
        elif shape < 0.8:
            core = f'<div {rng.choice(["class", "id"])}="{rng.choice(MAIN)}">{body()}</div>'
        elif shape < 0.9:
            core = wrap(body(), 1.0)
        else:
            core = body()
        if rng.random() < 0.1:  # a fragment: nothing but main text, often a single block
            labels.clear()
            core = wrap(piece() if rng.random() < 0.6 else body(), 0.6)
            yield core if rng.random() < 0.5 else f"<html><body>{core}</body></html>", labels
            continue
        # what stands around the main text may be wrapped by itself, or together with it
        before, after = (wrap("".join(x), 0.2) if rng.random() < 0.5 else "".join(wrap(y, 0.2) for y in x) for x in (before, after))
        whole = wrap(before + wrap(core, 0.3) + after, 0.4)
        yield f"<html><head><title>t</title></head><body>{whole}</body></html>", labels
