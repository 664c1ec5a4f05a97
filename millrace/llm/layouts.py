"""Labelled page layouts, made by rule: what the block classifier of maincontent is fitted on.

Each page is a list of (html, label) parts in page order; a part's text blocks all have its label,
1 for content and 0 for boilerplate. Boilerplate is marked by element, by name or not at all, content
has long and short paragraphs, headings, lists and tables, so no single sign tells the two apart.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba co de fi gu ha jo ke li mo nu pe ra si to vu".split()
_MARKED = (
    ("nav", ""), ("div", 'class="menu"'), ("footer", ""), ("aside", ""), ("div", 'id="sidebar"'), ("div", 'class="ad"'), ("div", 'class="cookie-notice"'),
    ("section", 'id="comments"'), ("div", 'class="related-posts"'), ("form", ""), ("div", 'class="site-footer"'), ("div", 'role="banner"'), ("div", 'class="newsletter"'), ("header", ""),
)
_WRAPS = (
    ("article", ""), ("main", ""), ("div", 'class="post-content"'), ("div", 'id="content"'), ("div", ""), ("section", ""), ("div", 'class="col-8"'), ("main", 'class="with-comments"'),
)


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentence(rng: random.Random, n: int) -> str:
    text = _words(rng, n)
    return text[:1].upper() + text[1:] + rng.choice(".....!?")


def _prose(rng: random.Random) -> str:
    n = rng.choice((1, 1, 2, 4, 6))
    return " ".join(_sentence(rng, rng.choice((2, 4, 9, 14, 20))) for _ in range(n))


def _content(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.68:
        text = _prose(rng)
        return f"<p>{text}" + (f' <a href="/x">{_words(rng, 2)}</a> {_words(rng, 3)}.</p>' if rng.random() < 0.2 else "</p>")
    if kind < 0.8:
        return f"<h{rng.randint(2, 4)}>{_words(rng, rng.randint(1, 6))}</h2>"
    if kind < 0.88:
        return "<ul>" + "".join(f"<li>{_words(rng, rng.randint(2, 9))}{rng.choice(('', '.'))}</li>" for _ in range(3)) + "</ul>"
    if kind < 0.93:
        return "<table>" + "".join(f"<tr><td>{_words(rng, 1)}</td><td>{_words(rng, 2)}</td></tr>" for _ in range(2)) + "</table>"
    return rng.choice((f"<blockquote>{_prose(rng)}</blockquote>", f"<div>{_prose(rng)}</div>", f"<figure><figcaption>{_sentence(rng, 5)}</figcaption></figure>"))


def _boilerplate(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.45:
        inner = "<ul>" + "".join(f'<li><a href="/{k}">{_words(rng, rng.randint(1, 3))}</a></li>' for k in range(rng.randint(2, 7))) + "</ul>"
    elif kind < 0.8:
        inner = rng.choice(("<p>{}</p>", "<div>{}</div>", "{}")).format(_sentence(rng, rng.choice((3, 6, 10, 16))))
    else:
        inner = f"<h3>{_words(rng, 2)}</h3><p>{_sentence(rng, 5)}</p>" + f'<a href="/y">{_words(rng, 2)}</a>'
    if rng.random() < 0.2 and "href" in inner:
        return f"<div>{inner}</div>"  # no sign but its links
    name, attrs = rng.choice(_MARKED)
    return f"<{name} {attrs}>{inner}</{name}>"


def pages(n: int, seed: int = 1) -> list[list[tuple[str, int]]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        name, attrs = rng.choice(_WRAPS)
        parts = [("<body class='has-sidebar'>" if rng.random() < 0.2 else "<body>", -1)]
        parts += [(_boilerplate(rng), 0) for _ in range(rng.randint(1, 3))]
        parts += [(f"<{name} {attrs}>", -1), (f"<h1>{_words(rng, rng.randint(2, 8))}</h1>", 1)]
        for _ in range(rng.randint(3, 12)):
            parts.append((_boilerplate(rng), 0) if rng.random() < 0.1 else (_content(rng), 1))
        parts += [(f"</{name}>", -1)] + [(_boilerplate(rng), 0) for _ in range(rng.randint(1, 4))]
        out.append(parts)
    return out
