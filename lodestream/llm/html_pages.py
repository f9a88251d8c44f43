"""Labelled training pages: layouts of common shape, filled with pseudo-words.

Texts start with MAIN or REST, which the reader of the pages takes off again as the
block's label."""

from __future__ import annotations

import random
from collections.abc import Iterator

MAIN, REST = "\ue000", "\ue001"
_SYLLABLES = "th er in on re an ti es or te de al ra ni lo ve ma ko su pa chi né ü ß que ión".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self, lo: int = 3, hi: int = 18) -> str:
        s = self.words(lo, hi).capitalize()
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s + self.r.choice(["."] * 8 + ["!", "?"])

    def prose(self, lo: int, hi: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def maybe(self, p: float, x: str) -> str:
        return x if self.r.random() < p else ""

    def pick(self, *xs: str) -> str:
        return self.r.choice(xs)

    def attr(self, *names: str) -> str:
        """One of the names as class or id, at times with others, at times nothing at all."""
        n = self.r.choice(names)
        return self.pick(f' class="{n}"', f' class="{n}"', f' id="{n}"', f' class="{self.word()} {n}"', f' class="{n}-{self.pick("box", "wrap", "inner", "1")}"')

    # boilerplate -------------------------------------------------------------
    def links(self, n: int, item: str = "li") -> str:
        text = lambda: self.r.choice([self.word(), self.words(1, 4).capitalize(), self.words(1, 2)])
        return "".join(f'<{item}><a href="/{i}">{REST}{text()}</a></{item}>' for i in range(n))

    def menu(self) -> str:
        ul = f"<ul>{self.links(self.r.randint(2, 9))}</ul>"
        flat = self.links(self.r.randint(2, 8), "span").replace(f"</a></span><span><a", "</a> | <a").replace(REST, "")
        return self.pick(f"<nav>{ul}</nav>", f"<nav{self.attr('main-nav', 'navbar', 'menu')}>{ul}</nav>", f"<div{self.attr('nav', 'menu', 'topnav', 'navigation', 'breadcrumbs')}>{ul}</div>", f'<div role="navigation">{ul}</div>', f"<nav>{REST}{flat}</nav>", f"<ul{self.attr('menu', 'nav')}>{self.links(self.r.randint(3, 8))}</ul>", f"<nav><p>{REST}{self.words(1, 4)}</p>{ul}</nav>")

    def header(self) -> str:
        inner = f"{self.maybe(0.6, f'<h1>{REST}{self.words(1, 4)}</h1>')}<p>{REST}{self.pick(self.words(2, 7), self.sentence())}</p>{self.maybe(0.4, self.menu())}"
        return self.pick(f"<header>{inner}</header>", f"<div{self.attr('header', 'masthead', 'site-header', 'banner', 'topbar')}>{inner}</div>", f'<div role="banner">{inner}</div>')

    def footer(self) -> str:
        c = self.pick("&copy; ", "© ", "Copyright ", "")
        inner = self.pick(f"{REST}{c}{self.word()}.example.com &middot; {self.prose(1, 2)}", f"<p>{REST}{c}{self.words(2, 6)}</p>", f"<p>{REST}{self.prose(1, 4)}</p><ul>{self.links(3)}</ul>", f"{REST}{c}2024 {self.sentence()}")
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{self.attr('footer', 'site-footer', 'copyright', 'legal', 'bottom')}>{inner}</div>", f'<div role="contentinfo">{inner}</div>')

    def advert(self) -> str:
        inner = self.pick(f"{REST}{self.prose(1, 3)}", f"<p>{REST}{self.prose(1, 3)}</p>", f'<a href="/x">{REST}{self.sentence()}</a>', f"<h3>{REST}{self.words(2, 5)}</h3><p>{REST}{self.prose(1, 3)}</p>")
        tag = self.pick("div", "div", "aside", "section", "p") if "<p>" not in inner and "<h3>" not in inner else "div"
        return f"<{tag}{self.attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'banner-ad')}>{inner}</{tag}>"

    def sidebar(self) -> str:
        inner = self.pick(f"<h3>{REST}{self.words(1, 3)}</h3><ul>{self.links(5)}</ul>", f"<h2>{REST}{self.words(1, 3)}</h2><p>{REST}{self.prose(1, 4)}</p>", f"<p>{REST}{self.prose(2, 5)}</p>", f"<ul>{self.links(6)}</ul>", f"{REST}{self.prose(1, 3)}")
        return self.pick(f"<aside>{inner}</aside>", f"<aside{self.attr('sidebar', 'related')}>{inner}</aside>", f"<div{self.attr('sidebar', 'side', 'widget', 'related', 'recommended', 'right-rail', 'trending')}>{inner}</div>", f'<div role="complementary">{inner}</div>')

    def notice(self) -> str:
        text = self.pick(self.prose(1, 3), "We use cookies. " + self.sentence(), self.sentence() + " Accept all cookies?")
        inner = self.pick(f"{REST}{text}", f"<p>{REST}{text}</p>{self.maybe(0.5, '<button>OK</button>')}")
        return f"<div{self.attr('cookie', 'cookie-notice', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'banner-notice', 'paywall')}{self.maybe(0.3, ' role="dialog"')}>{inner}</div>"

    def form(self) -> str:
        inner = f"{self.maybe(0.5, f'<p>{REST}{self.prose(1, 2)}</p>')}<label>{REST}{self.words(1, 3)}</label><input name=q>{self.maybe(0.6, '<button>Go</button>')}{self.maybe(0.3, '<select><option>a</option><option>b</option></select>')}"
        return self.pick(f"<form>{inner}</form>", f"<form{self.attr('newsletter', 'search', 'subscribe', 'login')}>{inner}</form>", f"<div{self.attr('newsletter', 'subscribe', 'signup')}><form>{inner}</form></div>")

    def comments(self) -> str:
        one = lambda: self.pick(f"<li><b>{REST}{self.word()}</b> {self.prose(1, 3)}</li>", f"<div{self.attr('comment', 'reply')}><p>{REST}{self.prose(1, 4)}</p></div>", f"<p>{REST}{self.prose(1, 3)}</p>", f"<article{self.attr('comment')}><p>{REST}{self.prose(1, 3)}</p></article>")
        inner = self.maybe(0.7, f"<h3>{REST}{self.words(1, 3)}</h3>") + "".join(one() for _ in range(self.r.randint(1, 6)))
        return f"<{(t := self.pick('section', 'div', 'div', 'ol'))}{self.attr('comments', 'comment-list', 'discussion', 'disqus', 'responses', 'replies')}>{inner}</{t}>"

    def share(self) -> str:
        return f"<div{self.attr('share', 'social', 'tags', 'meta', 'byline')}>{self.links(3, 'span').replace('<span>', '').replace('</span>', ' ').replace(REST, '') .replace('<a', REST + '<a', 1)}</div>"

    # the article -------------------------------------------------------------
    def paragraph(self) -> str:
        n = self.pick("1", "1", "2", "4", "9")
        s = self.prose(1, int(n))
        if self.r.random() < 0.12:
            s = self.words(1, 3).capitalize() + "."
        if self.r.random() < 0.12:
            s = s.replace(" ", self.pick("!! ", "$$$ ", " | ", "%%% ")).upper() if self.r.random() < 0.5 else s + " &amp; &lt;x&gt; " + self.words(3, 9)
        if self.r.random() < 0.06:  # a list or a table row, as text
            s = s.replace(" ", self.pick(" | ", " | ", " · ", " - ")) + self.pick("", " |")
        if self.r.random() < 0.06:
            s = s.rstrip(".!?")
        if self.r.random() < 0.2:
            s = s.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
        if self.r.random() < 0.15:
            s = s.replace(" ", f" <b>{self.word()}</b> ", 1)
        return MAIN + s

    def block(self) -> str:
        p = self.paragraph
        if self.r.random() < 0.06:  # what stands in footers too
            return f"<p>{MAIN}{self.pick('All rights reserved.', 'All rights reserved.', f'Copyright 2019 {self.word()}.', f'{self.sentence()} All rights reserved.', 'Terms of use apply.', f'Licensed under {self.words(1, 4)}.')}</p>"
        return self.pick(*[f"<p>{p()}</p>"] * 12, f"<p>{p()}", f"<p><b>{p()}<br>", f"<h2>{MAIN}{self.words(1, 6).capitalize()}</h2>", f"<ul><li>{p()}</li><li>{p()}</li></ul>", f"<blockquote>{p()}</blockquote>", f"<ol><li>{MAIN}{self.words(1, 5)}</li><li>{p()}</li></ol>", f"<div>{p()}</div>", f"<section><h3>{MAIN}{self.words(1, 4)}</h3><p>{p()}</p></section>", f"<pre>{MAIN}{self.words(3, 30)}</pre>", f"<table><tr><td>{MAIN}{self.words(1, 4)}</td><td>{MAIN}{self.words(1, 3)}</td></tr></table>", f"<figure><img src=x><figcaption>{MAIN}{self.sentence()}</figcaption></figure>", f"{p()}<br>{self.sentence()}<br><br>{self.sentence()}")

    def article(self) -> str:
        out = [self.maybe(0.85, self.pick(f"<h1>{MAIN}{self.words(2, 9).capitalize()}</h1>", f"<h1{self.attr('title', 'headline')}>{MAIN}{self.sentence()}</h1>"))]
        n = self.r.choice([1, 1, 2, 3, 4, 6, 9, 14])
        for _ in range(n):
            out.append(self.block())
            if self.r.random() < 0.08:
                out.append("</b>" + self.r.choice([self.advert, self.sidebar, self.form, self.share])())
        body = "".join(out)
        return self.pick(*[f"<article>{body}</article>"] * 3, f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div{self.attr('content', 'article', 'post', 'entry-content', 'story', 'article-body', 'main', 'text', 'post-body')}>{body}</div>", f'<div role="main">{body}</div>', f"<section{self.attr('content', 'article')}>{body}</section>", f"<td{self.attr('content', 'body')}>{body}</td>", f"<div{self.attr('wrapper', 'container', 'page')}><div{self.attr('content', 'post')}>{body}</div></div>", f"<div>{body}</div>")

    def table_page(self) -> str:
        """All in one table: rows of links, a cell of links beside the cell of the article, a last row of small print."""
        flat = lambda n, sep: REST + sep.join(f'<a href="{i}.html">{self.words(1, 3).capitalize()}</a>' for i in range(n))
        cell = lambda n, sep, *names: f"<td{self.maybe(0.4, self.attr(*names))}>{flat(n, sep)}</td>"
        body = f"{self.maybe(0.8, f'<h2>{MAIN}{self.words(2, 8).capitalize()}</h2>')}" + "".join(f"<p>{self.paragraph()}{self.maybe(0.4, '</p>')}" for _ in range(self.r.randint(1, 9)))
        main = f"<td{self.maybe(0.5, self.attr('content', 'main', 'text', 'body'))}>{body}</td>"
        rows = [self.maybe(0.8, f"<tr>{cell(self.r.randint(2, 7), self.pick(' | ', ' - ', ' '), 'nav', 'menu', 'top')}</tr>"), "<tr>" + self.maybe(0.8, cell(self.r.randint(2, 9), self.pick("<br>", "<br>", " | "), "menu", "side", "nav", "left")) + main + self.maybe(0.2, cell(4, "<br>", "right", "links", "ads")) + "</tr>"]
        rows.append(self.maybe(0.7, f"<tr><td>{REST}{self.pick('&copy; 1999 ', '')}{self.sentence()}</td></tr>"))
        return f"<html><head><title>{self.words(2, 5)}</title></head><body>{self.maybe(0.3, self.advert())}<table width=100%>{''.join(rows)}</table></body></html>"

    # pages and parts that no name or tag tells apart -------------------------------
    def odd(self) -> str:
        """A class or id that says nothing, or none."""
        n = self.pick(self.word()[:3], "f", "ftr", "x1", "b", self.word(), "c-" + self.word())
        return self.pick("", f" class={n}", f' id="{n}"')

    def small_print(self) -> str:
        names = ["Imprint", "Terms of use", "Terms", "Privacy", "Privacy policy", "Contact", "About", self.words(1, 2).capitalize()]
        row = self.pick(" | ", " · ", " - ", " ").join(self.r.sample(names, self.r.randint(2, 4)))
        owner = f"{self.words(1, 3).capitalize()}{self.pick('', ' Ltd.', ' Inc.')}"
        inner = self.pick(row, row, f"{self.pick('&copy; ', '© ', 'Copyright ')}{self.pick('2020 ', '1999-2024 ', '')}{self.pick(owner, '', self.sentence())}", f"All rights reserved. {owner}", f"{owner}. All rights reserved.", f"{row} {self.pick('&copy;', '©')} {owner}")
        tag = self.pick("div", "div", "p")
        return f"<{tag}{self.odd()}>{REST}{inner}</{tag}>"

    def small_menu(self) -> str:
        names = [self.pick(self.word(), self.words(1, 2)).capitalize() for _ in range(self.r.randint(2, 7))]
        sep = self.pick(" | ", " ", " · ")
        return f"<div{self.odd()}>{REST}{sep.join(names) if sep != ' ' and self.r.random() < 0.4 else sep.join(f'<a href={i}>{n}</a>' for i, n in enumerate(names))}</div>"

    def bare(self) -> str:
        """An article and nothing else: blocks, one paragraph, or text without any tag."""
        kind = self.r.random()
        if kind < 0.3:
            return self.pick("{}", "<body>{}</body>", "<html><head><title>t</title></head><body>{}</body></html>").format(MAIN + self.pick(self.prose(1, 6), self.words(2, 9).capitalize()))
        blocks = [f"<p>{MAIN}{self.prose(1, 6)}</p>"] if kind < 0.55 else [self.block() for _ in range(self.r.randint(1, 5))]
        title = self.maybe(0.4, f"<h1>{MAIN}{self.words(1, 7).capitalize()}</h1>")
        return self.pick("{}", "<body>{}</body>", "<html><body>{}</body></html>", "<body><div>{}</div></body>", "<article>{}</article>").format(title + "".join(blocks))

    def nameless(self) -> str:
        """An article with parts around it that only their texts and places tell."""
        art = "".join([self.maybe(0.8, f"<h1>{MAIN}{self.words(2, 8).capitalize()}</h1>"), *[f"<p>{self.paragraph()}</p>" for _ in range(self.r.randint(1, 7))]])
        art = self.pick(f"<article>{art}</article>", f"<div{self.odd()}>{art}</div>", art)
        return f"<html><body>{self.maybe(0.6, self.small_menu())}{art}{self.maybe(0.25, self.small_menu())}{self.maybe(0.85, self.small_print())}</body></html>"

    def page(self) -> str:
        kind = self.r.random()
        if kind < 0.12:
            return self.table_page()
        if kind < 0.2:
            return self.bare()
        if kind < 0.3:
            return self.nameless()
        before = [f() for f, p in ((self.notice, 0.25), (self.header, 0.4), (self.menu, 0.75), (self.advert, 0.4), (self.form, 0.12), (self.sidebar, 0.15)) if self.r.random() < p]
        after = [f() for f, p in ((self.share, 0.15), (self.comments, 0.35), (self.sidebar, 0.3), (self.advert, 0.25), (self.form, 0.2), (self.menu, 0.15), (self.footer, 0.8), (self.notice, 0.15)) if self.r.random() < p]
        if self.r.random() < 0.2:
            self.r.shuffle(before)
        art = self.article()
        if art.startswith("<td"):
            art = f"<table><tr>{self.maybe(0.6, f'<td{self.attr('nav', 'side')}>{self.links(4, 'p')}</td>')}{art}</tr></table>"
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>{"".join(before)}{self.maybe(0.2, "<!-- x -->")}{art}</b>{"".join(after)}</body></html>'


def training_pages(n: int, seed: int = 3) -> Iterator[str]:
    for i in range(n):
        yield _Page(seed * 1_000_003 + i).page()
