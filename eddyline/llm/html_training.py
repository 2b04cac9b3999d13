"""Labelled pages for the extraction model: generated layouts whose article blocks are known.

No table of labelled pages is at hand, so pages are composed here, from a fixed seed, of the parts
that web pages have: site headers, navigation, notices, adverts, sidebars, forms, reader comments, footers
and articles, with and without telling tags and class names. Article text begins with MARK.
"""

from __future__ import annotations

import random

#: Begins the text of blocks that belong to the article.
MARK = "✓"
_ALPHABET = ("er", "th", "an", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = "plain"

    def words(self, least: int, most: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(_ALPHABET, k=r.randint(1, 4))) for _ in range(r.randint(least, most)))

    def sentence(self, least: int = 4, most: int = 18) -> str:
        s = self.words(least, most).capitalize()
        if self.style == "marks":
            return " ".join(w + self.any("###", "&amp;&amp;&amp;", "***", "%%", "=") for w in s.split())
        if self.style == "cells":
            return s.replace(" ", " | ")
        if self.style == "bare":
            return s
        return (s.replace(" ", ", ", 1) if self.r.random() < 0.3 else s) + self.r.choice("...?!")

    def prose(self, least: int, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(least, most)))

    def any(self, *these: str) -> str:
        return self.r.choice(these)

    def box(self, inner: str, tags: tuple[str, ...], names: tuple[str, ...], bare: float = 0.15) -> str:
        """inner in a telling tag, or a div or section with a telling name, seldom in neither."""
        r = self.r
        x = r.random()
        if tags and x < 0.45:
            tag = r.choice(tags)
            extra = f' class="{r.choice(names)}"' if names and r.random() < 0.4 else ""
            return f"<{tag}{extra}>{inner}</{tag}>"
        if names and x < 1 - bare:
            tag = self.any("div", "div", "section")
            name = r.choice(names)
            name = self.any(name, name, f"{name} {self.words(1, 1)}", f"site-{name}", f"{name}-wrap", f"{name}_box")
            return f'<{tag} {self.any("class", "class", "id")}="{name}">{inner}</{tag}>'
        return f"<div>{inner}</div>"

    def link(self, least: int = 1, most: int = 4) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(least, most).capitalize()}</a>'

    def links(self, least: int = 3, most: int = 9) -> str:
        items = [self.link() for _ in range(self.r.randint(least, most))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.any(" | ", " ", " &middot; ").join(items)

    def paragraph(self, least: int, most: int) -> str:
        """Plain or marked-up prose."""
        text, x = self.prose(least, most), self.r.random()
        if x < 0.25:
            a, _, b = text.partition(" ")
            return f"{a} <{(t := self.any('b', 'em', 'i', 'strong', 'span'))}>{b}</{t}>"
        return text + (f" {self.link(1, 6)} {self.sentence()}" if x < 0.45 else "")

    # parts outside the article
    def header(self) -> str:
        inner = f"<div>{self.words(1, 3).title()}</div>" + (f"<p>{self.sentence(2, 7)}</p>" if self.r.random() < 0.4 else "")
        return self.box(inner + (self.nav() if self.r.random() < 0.4 else ""), ("header",), ("header", "masthead", "top", "banner", "branding", "logo"))

    def nav(self) -> str:
        return self.box(self.links(), ("nav", "nav", "menu"), ("nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "pagination", "toc"), 0.2)

    def notice(self) -> str:
        return self.box(f"<p>{self.prose(1, 3)}</p>" + self.any("", f"<button>{self.words(1, 2)}</button>", self.link()), ("dialog", "aside"), ("cookie", "cookies", "consent", "notice", "gdpr", "alert", "banner", "privacy", "modal", "popup", "paywall"), 0)

    def ad(self) -> str:
        return self.box(self.any(self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.words(2, 5)}</h3><p>{self.sentence()}</p>", self.link(3, 9)), ("ins", "aside"), ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner"), 0)

    def sidebar(self) -> str:
        inner = "".join(self.any(f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 4)}</p>", f"<p>{self.prose(1, 3)}</p>") for _ in range(self.r.randint(1, 3)))
        return self.box(inner, ("aside", "aside"), ("sidebar", "widget", "related", "popular", "recommended", "more", "trending", "side", "aside"), 0)

    def share(self) -> str:
        return self.box(self.any(self.links(2, 4), self.sentence(2, 5) + self.link()), (), ("share", "social", "sharing", "tags", "meta", "tools", "related", "newsletter", "subscribe"), 0)

    def form(self) -> str:
        fields = "".join(f'<label>{self.words(1, 3)}</label><input name="{self.words(1, 1)}">' + self.any("", f"<p>{self.sentence()}</p>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>") for _ in range(self.r.randint(1, 3)))
        return self.box(f"<form>{self.any('', f'<p>{self.prose(1, 2)}</p>')}{fields}<button>{self.words(1, 2)}</button></form>", (), ("search", "subscribe", "newsletter", "contact", "login", "signup", "form"), 0.5)

    def comments(self) -> str:
        one = lambda: self.any(f'<div class="{self.any("comment", "comment-body", "reply")}"><b>{self.words(1, 2)}</b><p>{self.prose(1, 6)}</p></div>', f"<li><p>{self.prose(1, 6)}</p></li>", f"<article><p>{self.words(1, 2)}</p><p>{self.prose(1, 6)}</p></article>", f"<p>{self.prose(1, 6)}</p>")
        inner = self.any("", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 2)}</h2>") + "".join(one() for _ in range(self.r.randint(1, 7)))
        tag = self.any("section", "div", "div", "ol", "aside")
        return f'<{tag} {self.any("class", "id")}="{self.any("comments", "comments", "comment-list", "replies", "responses", "discussion", "reader-comments", "disqus", "reviews", "user-comments")}">{inner}</{tag}>'

    def footer(self) -> str:
        return self.box(self.any("", "<p>") + f"&copy; {self.any('2019', self.words(1, 1))} {self.prose(0, 3)}" + self.any("", self.links(2, 5)), ("footer", "footer"), ("footer", "bottom", "copyright", "legal", "colophon"), 0)

    def unscripted(self) -> str:
        return f"<noscript>{self.any(self.sentence(), f'<p>{self.prose(1, 2)}</p>', f'<div>{self.prose(1, 2)}</div>')}</noscript>"

    def hidden(self) -> str:
        """A part that is not shown at first."""
        inner = self.any(self.links(), f"<p>{self.prose(1, 3)}</p>{self.link()}", f"<div>{self.words(1, 3)}</div>")
        return f"<{(t := self.any('div', 'nav', 'section'))} {self.any('hidden', 'style=\"display:none\"')}>{inner}</{t}>"

    # the article
    def article(self, bare: bool) -> str:
        r, out = self.r, []
        mark = lambda s: MARK + s
        if r.random() < 0.85:
            out.append(f"<h1>{mark(self.words(2, 12)).capitalize()}</h1>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            x = r.random()
            if x < 0.62:
                close = self.any("</p>", "</p>", "</p>", "<br></p>", "")
                out.append(f"<p>{mark(self.paragraph(1, 12))}{close}")
            elif x < 0.72:
                out.append(f"<p>{mark(self.any(self.words(1, 3).capitalize() + '.', self.words(1, 2), self.sentence(1, 3)))}</p>")
            elif x < 0.79:
                out.append(f"<h{(k := self.any('2', '3', '4'))}>{mark(self.words(1, 7))}</h{k}>")
            elif x < 0.85:
                out.append(f"<{(k := self.any('ul', 'ol'))}>" + "".join(f"<li>{mark(self.any(self.words(1, 5), self.sentence()))}" + self.any("</li>", "") for _ in range(r.randint(2, 6))) + f"</{k}>")
            elif x < 0.89:
                out.append(f"<blockquote>{self.any(mark(self.prose(1, 4)), f'<p>{mark(self.prose(1, 4))}</p>')}</blockquote>")
            elif x < 0.92:
                out.append(f"<pre>{mark(self.words(3, 40))}</pre>")
            elif x < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.97:
                out.append(f"<figure><img src=x><figcaption>{mark(self.sentence())}</figcaption></figure>")
            else:
                shut = self.any("", "", " hidden", ' style="display: none"')  # what opens at a click
                out.append(f"<{(t := self.any('div', 'p', 'section') if shut else 'div')}{shut}>{mark(self.prose(1, 8))}</{t}>")
            if r.random() < 0.07:
                out.append(self.any(self.ad(), self.share(), self.sidebar()) if not bare else self.ad())
        inner = "".join(out)
        if r.random() < 0.12:
            inner += self.comments()
        if bare:
            return inner
        x = r.random()
        if x < 0.5:
            inner = f"<article>{inner}</article>"
        elif x < 0.65:
            inner = f"<main>{inner}</main>"
        elif x < 0.9:
            name = self.any("content", "article", "post", "entry", "entry-content", "post-body", "story", "article-body", "main", "main-content", "text")
            inner = f'<{(t := self.any("div", "div", "section"))} {self.any("class", "id")}="{name}">{inner}</{t}>'
        else:
            inner = f"<div>{inner}</div>"
        return f"<main>{inner}</main>" if r.random() < 0.15 else inner

    def page(self) -> str:
        r = self.r
        self.style = r.choice(("plain",) * 7 + ("marks", "cells", "bare"))
        some = lambda p, f: f() if r.random() < p else ""
        before = [some(0.6, self.header), some(0.7, self.nav), some(0.25, self.notice), some(0.4, self.ad), some(0.2, self.form), some(0.2, self.sidebar)]
        r.shuffle(before)
        before = [some(0.12, self.unscripted), some(0.08, self.hidden), *before]
        if r.random() < 0.15:
            before = []
        after = [some(0.35, self.sidebar), some(0.35, self.comments), some(0.2, self.ad), some(0.2, self.share), some(0.2, self.form)]
        r.shuffle(after)
        return (
            f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>" + "".join(before) + self.article(r.random() < 0.12)
            + "".join(after) + some(0.8, self.footer) + some(0.1, self.notice) + some(0.15, self.hidden) + "</body></html>"
        )


def labelled_pages(n: int, seed: int) -> list[str]:
    made = Pages(seed)
    return [made.page() for _ in range(n)]
