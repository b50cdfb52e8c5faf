"""Labelled training pages by rule: layouts with marked main text.

Every page marks its main blocks with ``data-main="1"`` and boilerplate inside
them with ``data-main="0"``; the marks are read as labels only, never as
features.  Words, layouts, class names and lengths vary with the seed.
"""

from __future__ import annotations

import random

_SYLLABLES = "ta ri lo men sur ka pel dor vi nus ex tra fo gri shi bal ou ne".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        for i in range(len(out)):
            if r.random() < 0.1:
                out[i] += r.choice(",.;")
        return (" ".join(out)).capitalize() + r.choice([".", ".", "", "!"])

    def attr(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        name = r.choice(names)
        if r.random() < 0.3:
            name = r.choice(["site-", "page-", "js-", "l-"]) + name
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items)

    def any(self, *makers) -> str:
        return self.r.choice(makers)()

    def menu(self):
        if self.r.random() < 0.6:
            return f"<nav{self.attr('menu', 'navbar', 'nav')}>{self.links(3, 9)}</nav>"
        return f"<div{self.attr('navigation', 'menu', 'breadcrumbs', 'toc')}>{self.links(2, 9)}</div>"

    def top(self):
        tag = self.r.choice(["header", "header", "div"])
        title = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 6)}</p>",
                               f'<a href="/">{self.words(1, 3)}</a>'])
        return f"<{tag}{self.attr('header', 'masthead', 'topbar', 'branding')}>{title}{self.any(self.menu, str, str)}</{tag}>"

    def bottom(self):
        tag = self.r.choice(["footer", "footer", "div"])
        text = self.r.choice([f"&copy; {self.words(2, 12)}", f"<p>{self.words(4, 20)}</p>", self.links(2, 6)])
        return f"<{tag}{self.attr('footer', 'copyright', 'legal', 'colophon')}>{text}</{tag}>"

    def advert(self):
        tag = self.r.choice(["div", "div", "aside", "section"])
        text = self.words(3, 25)
        return f"<{tag}{self.attr('ad', 'advert', 'sponsored', 'promo', 'ads')}>{self.r.choice([text, f'<p>{text}</p>'])}</{tag}>"

    def side(self):
        tag = self.r.choice(["aside", "aside", "div", "section"])
        inner = self.any(lambda: f"<h3>{self.words(1, 4)}</h3>{self.links(2, 7)}",
                         lambda: "".join(f"<p>{self.words(4, 30)}</p>" for _ in range(self.r.randint(1, 3))))
        return f"<{tag}{self.attr('sidebar', 'related', 'widget', 'recommended', 'share')}>{inner}</{tag}>"

    def notice(self):
        button = self.r.choice(["", f"<button>{self.words(1, 2)}</button>", f'<a href="#">{self.words(1, 2)}</a>'])
        return (f"<div{self.attr('cookie', 'cookie-banner', 'consent', 'notice', 'newsletter', 'alert')}>"
                f"<p>{self.words(5, 40)}</p>{button}</div>")

    def form(self):
        return (f"<form{self.attr('search', 'login', 'subscribe')}><label>{self.words(1, 4)}</label><input type=text>"
                f"{self.r.choice(['', f'<p>{self.words(3, 15)}</p>'])}<button>{self.words(1, 2)}</button></form>")

    def readers(self):
        tag = self.r.choice(["section", "div", "div"])
        one = self.r.choice(["<div class=\"comment\"><b>{n}</b><p>{t}</p></div>", "<li class=\"comment\">{n}: {t}</li>",
                             "<article class=\"comment\"><p>{t}</p></article>", "<p>{t}</p>"])
        inner = "".join(one.format(n=self.words(1, 2), t=self.words(4, 60)) for _ in range(self.r.randint(1, 6)))
        if "<li" in one:
            inner = f"<ol>{inner}</ol>"
        name = self.r.choice(["comments", "comment-list", "discussion", "replies", "reader-comments"])
        return f'<{tag} {self.r.choice(["class", "id"])}="{name}"><h2>{self.words(1, 3)}</h2>{inner}</{tag}>'

    def block(self):
        r = self.r
        inner = self.words(*r.choice([(1, 8), (10, 60), (40, 200)]))
        k = r.random()
        if k < 0.68:
            start = f"<b>{self.words(3, 12)}<br>" if r.random() < 0.2 else ""
            link = f' <a href="/x">{self.words(1, 5)}</a> {self.words(1, 9)}' if r.random() < 0.15 else ""
            return f"<p>{start}{inner}{link}" + ("</p>" if r.random() < 0.9 else "")
        if k < 0.78:
            return f"<h{r.randint(2, 4)}>{self.words(1, 8)}</h{r.randint(2, 4)}>"
        if k < 0.88:
            return "<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if k < 0.94:
            return f"<blockquote><p>{inner}</p></blockquote>"
        if k < 0.97:
            return f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>"
        return f"<pre>{inner}</pre>"

    def main(self):
        r = self.r
        blocks = [self.block() for _ in range(r.choice([0, 1, 2, 4, 8, 15]))]
        if r.random() < 0.25:
            blocks.insert(r.randint(0, len(blocks)), f'<div data-main="0">{self.any(self.advert, self.side, self.form, self.notice)}</div>')
        head = f"<h1>{self.words(2, 12)}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        tag, names = r.choice([("article", ("article", "post", "entry")), ("article", ("",)), ("main", ("content", "main")),
                               ("div", ("content", "article-body", "post-content", "story", "entry-content"))])
        if not blocks and not head:
            head = f"<p>{self.words(3, 20)}</p>"
        return f"<{tag}{self.attr(*names) if names[0] else ''} data-main=\"1\">{head}{''.join(blocks)}</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [m() for m in (self.notice, self.top, self.menu, self.advert, self.form) if r.random() < 0.55]
        after = [m() for m in (self.side, self.advert, self.readers, self.notice, self.form, self.bottom) if r.random() < 0.55]
        body = [*before, self.main() if r.random() < 0.97 else "", *after]
        if r.random() < 0.35:
            cut = len(before)
            inner = "".join(body[cut:cut + 2])
            body = [*before, f"<div{self.attr('wrapper', 'container', 'row', 'page')}>{inner}</div>", *body[cut + 2:]]
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{''.join(body)}</body></html>"


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    return [_Maker(seed * 100_003 + i).page() for i in range(n)]
