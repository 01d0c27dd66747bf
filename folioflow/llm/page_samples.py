"""Generated labelled pages: (html, main text) in many layouts, to train the page chain."""

from __future__ import annotations

import random
from collections.abc import Iterator

PAGES = 900
SEED = 7

# Names that page authors commonly give to the parts of a page.
NAMES = {
    "nav": ["nav", "menu", "navbar", "navigation", "main-menu", "site-nav", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "tabs", "pagination", "skip-links", "toc"],
    "header": ["header", "masthead", "site-header", "page-header", "branding", "logo", "top", "tagline", "hero-banner"],
    "footer": ["footer", "site-footer", "colophon", "copyright", "legal", "bottom", "page-footer", "footer-links", "imprint"],
    "side": ["sidebar", "aside", "widget", "rail", "secondary", "related", "related-posts", "recommended", "popular", "trending", "recent-posts", "tag-cloud", "archives", "side-column", "more-stories", "blogroll"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "announcement", "cookies", "warning", "message-bar"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner", "ad-slot", "ad-unit", "adsense", "commercial", "partner-offer", "adsbygoogle", "ad-container", "adbox", "dfp-ad"],
    "form": ["form", "search", "search-box", "login", "newsletter", "subscribe", "signup", "contact-form", "newsletter-signup", "subscription", "register"],
    "social": ["share", "social", "share-buttons", "follow-us", "social-links", "sharing"],
    "comments": ["comments", "comment-list", "comment", "replies", "respond", "discussion", "disqus", "responses", "reader-comments", "feedback", "reactions", "user-comments", "comments-area", "reply"],
    "main": ["content", "main-content", "post", "post-content", "entry", "entry-content", "article", "article-body", "story", "story-text", "article-text", "body-text", "main", "post-body", "page-content", "text", "hentry", "single-post", "prose", "news-item", "primary"],
    "wrap": ["page", "wrapper", "container", "site", "layout", "row", "inner", "outer", "grid", "wrap", "app", "root", "col", "columns", "section"],
}
TAGS = {
    "nav": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "form": ["form"], "main": ["article", "main"],
    "comments": ["section"], "notice": ["section", "dialog"], "ad": ["aside"], "social": ["section"],
}


class Page:
    """One generated page under construction."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.lines = rng, [], []
        self.semantic = rng.random()

    def words(self, low: int, high: int, end: str = ".") -> str:
        rng = self.rng
        text = " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high)))
        return text.capitalize() + end

    def open(self, kind: str) -> str:
        """Open an element of a kind, by a landmark tag, by names or by both; returns the end tag."""
        rng = self.rng
        by_tag = kind in TAGS and rng.random() < self.semantic
        tag = rng.choice(TAGS[kind]) if by_tag else rng.choice(["div", "div", "section"])
        named = not by_tag or tag == "section" or rng.random() < 0.4
        names = ""
        if named:
            name = rng.choice(NAMES[kind])
            if rng.random() < 0.2:
                name += " " + rng.choice(NAMES["wrap"])
            if rng.random() < 0.15:
                name = name.replace("-", "_")
            names = f' {rng.choice(["class", "class", "id"])}="{name}"'
        self.out.append(f"<{tag}{names}>")
        return f"</{tag}>"

    def links(self, low: int, high: int) -> None:
        rng, many = self.rng, self.rng.randint(low, high)
        items = [f'<a href="/{i}">{self.words(1, 4, "")}</a>' for i in range(many)]
        if rng.random() < 0.7:
            self.out.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
        else:
            self.out.append(rng.choice([" | ", " ", " &middot; "]).join(items))

    def main(self, html: str, text: str) -> None:
        self.out.append(html)
        self.lines.append(text)

    def paragraph(self) -> None:
        rng = self.rng
        pick, text = rng.random(), self.words(*rng.choice([(1, 6), (5, 20), (15, 60), (40, 150)]), rng.choice([".", ".", ".", "", "!", "?"]))
        shown = text
        if rng.random() < 0.2:
            first, _, rest = text.partition(" ")
            shown = f'<a href="#">{first}</a> {rest}' if rest else text
        if pick < 0.72:
            self.main(rng.choice([f"<p>{shown}</p>", f"<p>{shown}</p>", f"<p>{shown}", f"<p><b>{shown}<br>", f'<p class="{rng.choice(["lead", "first", "para"])}">{shown}</p>']), text)
        elif pick < 0.8:
            tag = rng.choice(["h2", "h3", "h4"])
            self.main(f"<{tag}>{shown}</{tag}>", text)
        elif pick < 0.88:
            tag = rng.choice(["blockquote", "pre", "div", "figcaption"])
            self.main(f"<{tag}>{shown}</{tag}>", text)
        elif pick < 0.95:
            self.out.append("<ul>")
            for _ in range(rng.randint(2, 5)):
                item = self.words(2, 15, rng.choice(["", "."]))
                self.main(f"<li>{item}</li>", item)
            self.out.append("</ul>")
        else:
            self.out.append("<table>")
            for _ in range(rng.randint(1, 3)):
                self.out.append("<tr>")
                for _ in range(2):
                    item = self.words(1, 5, "")
                    self.main(f"<td>{item}</td>", item)
                self.out.append("</tr>")
            self.out.append("</table>")

    def side(self, kind: str) -> None:
        """A part that is not main text."""
        rng, end = self.rng, self.open(kind)
        if kind == "nav":
            self.links(2, 8)
        elif kind == "header":
            self.out.append(rng.choice(["<h1>{}</h1>", "<div>{}</div>", '<a href="/">{}</a>', "<p>{}</p>"]).format(self.words(1, 5, "")))
            if rng.random() < 0.5:
                self.links(2, 6)
            if rng.random() < 0.4:
                self.out.append(f"<p>{self.words(3, 10)}</p>")
        elif kind == "footer":
            if rng.random() < 0.5:
                self.links(2, 6)
            self.out.append(rng.choice(["<p>{}</p>", "{}", "<small>{}</small>"]).format(rng.choice(["&copy; ", "Copyright ", "", ""]) + self.words(2, 25)))
        elif kind == "form":
            self.out.append(f'<label>{self.words(1, 4, "")}</label><input name="q"><button>{self.words(1, 2, "")}</button>')
            if rng.random() < 0.5:
                self.out.append(f"<p>{self.words(3, 25)}</p>")
        elif kind == "social":
            self.links(2, 5)
        elif kind == "comments":
            self.out.append(f"<h3>{self.words(1, 3, '')}</h3>")
            for _ in range(rng.randint(1, 6)):
                body = self.words(*rng.choice([(2, 15), (10, 60)]))
                if rng.random() < 0.6:
                    self.out.append(f'<div class="{rng.choice(NAMES["comments"])}"><p class="{rng.choice(["author", "user", "name", "meta"])}">{self.words(1, 3, "")}</p><p>{body}</p></div>')
                else:
                    self.out.append(rng.choice(["<p>{}</p>", "<li>{}</li>", "<div>{}</div>"]).format(body))
            if rng.random() < 0.3:
                self.side("form")
        elif kind == "side":
            self.out.append(f"<h3>{self.words(1, 4, '')}</h3>")
            if rng.random() < 0.6:
                self.links(2, 7)
            if rng.random() < 0.5:
                self.out.append(f"<p>{self.words(4, 40)}</p>")
        else:
            self.out.append(rng.choice(["<p>{}</p>", "{}", "{}", '<p>{} <a href="/x">Ok</a></p>', "<span>{}</span>"]).format(self.words(3, rng.choice([12, 40]))))
        self.out.append(end)


def labelled_page(rng: random.Random) -> tuple[str, str]:
    p = Page(rng)
    if rng.random() < 0.03:
        text = p.words(1, 30)
        return rng.choice(["{}", "<p>{}", "<html><body>{}</body></html>"]).format(text), text
    p.out.append("<!DOCTYPE html><html><head><title>" + p.words(2, 8, "") + "</title><style>p{margin:0}</style></head><body>")
    wraps = [p.open("wrap") for _ in range(rng.randint(0, 2))]
    for kind in ("notice", "header", "nav", "ad", "form"):
        if rng.random() < 0.55:
            p.side(kind)
    if rng.random() < 0.25:
        p.side("side")
    columns = p.open("wrap") if rng.random() < 0.3 else ""
    ends = [p.open("main") for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2, 2]))]
    if rng.random() < 0.85:
        title = p.words(2, 12, rng.choice(["", "."]))
        inside = rng.random() < 0.2
        p.main(f"<header><h1>{title}</h1></header>" if inside else f"<h1>{title}</h1>", title)
    for _ in range(rng.randint(1, 14)):
        p.paragraph()
        if rng.random() < 0.12:
            p.side(rng.choice(["ad", "ad", "social", "side", "notice", "form", "nav"]))
    for kind in ("social", "comments", "side", "footer"):
        if rng.random() < 0.2:
            p.side(kind)
    p.out += reversed(ends)
    for kind in ("social", "comments", "side", "form", "ad"):
        if rng.random() < 0.35:
            p.side(kind)
    p.out.append(columns)
    for kind in ("side", "notice", "footer", "nav"):
        if rng.random() < 0.4:
            p.side(kind)
    p.out += reversed(wraps)
    p.out.append("<script>track('</p>');</script>" + rng.choice(["</body></html>", ""]))
    return "".join(p.out), "\n".join(p.lines)


def labelled_pages(count: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, str]]:
    rng = random.Random(seed)
    for _ in range(count):
        yield labelled_page(rng)
