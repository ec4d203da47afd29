"""Labelled pages for the extraction model: layouts put together by chance, with words of real pages.

No table says which part of a page is its article, so pages are laid out here where that is known: the attribute
data-main marks elements of the article, which the reader takes as labels and never as features.  Layouts vary in
elements, names and order, so that no one of them decides alone.
"""

from __future__ import annotations

import html
import random

#: Names that sites give to parts of their pages (fixed values).
NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar tabs links pagination pager toc",
    "header": "header masthead banner logo site title branding top head site-header page-header",
    "footer": "footer copyright colophon bottom legal site-footer page-footer imprint",
    "sidebar": "sidebar aside widget related recent popular trending recommended tags archive rail side more",
    "notice": "cookie consent notice alert gdpr popup modal newsletter subscribe paywall disclaimer overlay warning message cookie-banner cookies",
    "advert": "ad ads advert advertisement sponsor sponsored promo adsbygoogle banner-ad partner adslot teaser",
    "form": "search login signup form contact subscribe-form newsletter-form register search-box",
    "comments": "comments comment respond disqus reviews discussion replies comment-list responses reader",
    "share": "share social sharing follow tools buttons",
    "content": "post entry content story article body main text entry-content post-body article-content story-body page-content blog-post article-body prose",
}
NAMES = {kind: names.split() for kind, names in NAMES.items()}
WRAPS = {
    "menu": ["nav", "nav", "ul", "div"],
    "header": ["header", "header", "div"],
    "footer": ["footer", "footer", "div"],
    "sidebar": ["aside", "aside", "div", "section"],
    "notice": ["div", "section", "aside", "dialog", "p"],
    "advert": ["div", "div", "aside", "p", "section"],
    "form": ["form", "form", "div"],
    "comments": ["section", "div", "ol"],
    "share": ["div", "ul", "p"],
}
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Next page", "Previous"],
    "header": ["Welcome", "Home", "The daily site"],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Imprint"],
    "sidebar": ["Related", "Read more", "Popular", "Tags", "Recent posts", "Follow us"],
    "notice": ["We use cookies.", "Accept cookies", "Please enable JavaScript", "Subscribe to our newsletter", "This site uses cookies to improve."],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Anzeige", "Publicité"],
    "form": ["Search", "Your e-mail", "Log in", "Name", "Send"],
    "comments": ["Comments", "Leave a reply", "Reply", "said"],
    "share": ["Share this", "Tweet", "Print"],
}


class Layout:
    def __init__(self, rng: random.Random, sentences: list[str]):
        self.rng, self.sentences = rng, sentences

    def sentence(self) -> str:
        return self.rng.choice(self.sentences)

    def words(self, most: int) -> str:
        return " ".join(self.sentence().split()[: self.rng.randint(1, most)]).strip(".,;")

    def text(self, most: int = 6) -> str:
        return html.escape(" ".join(self.sentence() for _ in range(self.rng.randint(1, most))))

    def link(self, most: int = 4) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{html.escape(self.words(most))}</a>'

    def named(self, kind: str, always: bool = False) -> str:
        """A class, an id, both or neither."""
        name, other = self.rng.choice(NAMES[kind]), self.rng.choice(NAMES[kind])
        put = [f' class="{name}"', f' class="{name} {other}"', f' id="{name}"', f' class="{name}" id="{other}"']
        return self.rng.choice(put) if always or self.rng.random() < 0.7 else ""

    def items(self, kind: str) -> list[str]:
        """What a part of the page holds, by its kind."""
        r = self.rng
        phrase = r.choice(PHRASES[kind])
        if kind in ("menu", "share"):
            return [f"<li>{self.link()}</li>" if r.random() < 0.7 else self.link() for _ in range(r.randint(2, 9))] + [phrase] * r.randint(0, 1)
        if kind == "header":
            return [r.choice([f"<h1>{html.escape(self.words(4))}</h1>", f"<p>{self.link(3)}</p>", f"<div>{phrase}</div>"]), f"<p>{self.text(1)}</p>"][: r.randint(1, 2)]
        if kind == "footer":
            return [r.choice([f"&copy; {self.words(2)} &middot; {self.text(1)}", f"<p>© 2024 {self.words(3)}. {phrase}</p>", f"<p>{self.text(1)}</p>"]), self.link()][: r.randint(1, 2)]
        if kind == "sidebar":
            return [f"<h3>{phrase if r.random() < 0.5 else html.escape(self.words(4))}</h3>"] + [r.choice([f"<li>{self.link(9)}</li>", f"<p>{self.link(7)}</p>", f"<p>{self.text(2)}</p>"]) for _ in range(r.randint(1, 6))]
        if kind == "form":
            return [f"<label>{phrase}</label><input name=q>", f"<p>{self.text(1)}</p>", f"<button>{r.choice(PHRASES[kind])}</button>"]
        if kind == "comments":
            said = [f'<p class="{r.choice(["author", "meta", "by"])}">{html.escape(self.words(2))} {r.choice(["", "said", "12:30"])}</p><p>{self.text(4)}</p>' for _ in range(r.randint(1, 6))]
            inner = r.choice([f'<{t}{self.named("comments", always=True)}>' for t in ("div", "li", "article")])
            close = "</" + inner[1:-1].split()[0] + ">"
            return [f"<h3>{phrase}</h3>"] + [inner + x + close for x in said]
        said = r.choice([self.text(2), phrase, f"{phrase} {self.text(1)}", f"<p>{self.text(3)}</p>", f"<p>{phrase}</p><p>{self.text(1)} {self.link()}</p>"])
        return [said, f"<button>{r.choice(['OK', 'Accept', 'Close'])}</button>"][: r.randint(1, 2)]

    def part(self, kind: str) -> str:
        tag = self.rng.choice(WRAPS[kind])
        plain = tag in ("div", "p", "section", "ul", "ol", "dialog") or tag == "aside" and kind != "sidebar"
        return f"<{tag}{self.named(kind, always=plain)}>{''.join(self.items(kind))}</{tag}>"

    def paragraph(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.62:
            text = self.text()
            if kind < 0.12:  # a line of a few words, or one that other parts of a page hold as well
                text = html.escape(self.words(3)) + r.choice(["", ".", " |", "$$$"]) if kind < 0.08 else r.choice(PHRASES[r.choice(sorted(PHRASES))])
            elif r.random() < 0.2:
                text += f" {self.link()} {self.text(1)}"
            return r.choice(["<p data-main>{}</p>", "<p data-main>{}</p>", "<p data-main>{}", "<p data-main><b>{}<br>", "<div data-main>{}</div>", "<p data-main>{}<br>"]).format(text)
        if kind < 0.74:
            return f"<{(t := r.choice(['h2', 'h3', 'h4']))} data-main>{html.escape(self.words(8))}</{t}>"
        if kind < 0.84:
            return "<ul data-main>" + "".join(f"<li>{self.text(1)}" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote data-main><p>{self.text(3)}</p></blockquote>"
        if kind < 0.94:
            return f"<figure data-main><img src=a.png><figcaption>{self.text(1)}</figcaption></figure>"
        if kind < 0.97:
            return "<table data-main>" + "".join(f"<tr><td>{html.escape(self.words(3))}<td>{html.escape(self.words(3))}" for _ in range(3)) + "</table>"
        return f"<pre data-main>{self.text(2)}</pre>"

    def article(self) -> str:
        r = self.rng
        inner = []
        if r.random() < 0.85:
            head = f"<h1 data-main>{html.escape(self.words(12))}</h1>"
            inner.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        for _ in range(r.randint(1, 14)):
            inner.append(self.paragraph())
            if r.random() < 0.07:
                inner.append(self.part(r.choice(["advert", "share", "sidebar", "notice", "form"])))
        if r.random() < 0.12:
            inner.append(self.part(r.choice(["share", "footer", "comments", "sidebar"])))
        name = self.named("content", always=True)
        opened, closed = r.choice(
            [*[("<article>", "</article>")] * 5, (f"<article{name}>", "</article>"), ("<main>", "</main>"), (f"<main{name}><article>", "</article></main>"),
             (f"<div{name}>", "</div>"), (f"<div{name}>", "</div>"), (f"<section{name}>", "</section>"), (f"<div{name}><div{self.named('content')}>", "</div></div>"),
             (f"<table><tr><td{name}>", "</td></tr></table>"), ("<div>", "</div>")]
        )
        return opened + "".join(inner) + closed

    def page(self) -> str:
        r = self.rng
        before = [self.part(k) for k in ("header", "menu", "notice", "advert", "menu", "form", "sidebar") if r.random() < 0.45]
        after = [self.part(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer") if r.random() < 0.45]
        r.shuffle(before)
        middle = [self.article()] if r.random() < 0.95 else []
        if r.random() < 0.3:
            wrap = r.choice(['<div class="wrapper">', '<div id="page">', '<div class="container">'])
            middle = [wrap, *middle, "</div>"]
        return f"<!DOCTYPE html><html><head><title>{html.escape(self.words(6))}</title></head><body>{''.join(before + middle + after)}</body></html>"


def labelled_pages(sentences: list[str], n: int, seed: int = 0) -> list[str]:
    layout = Layout(random.Random(seed), sentences)
    return [layout.page() for _ in range(n)]
