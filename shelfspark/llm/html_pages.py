"""Invented pages with labelled blocks, to train the block labeller of ``html_extraction``.

A page is a site's frame (menus, headers, notices, adverts, sidebars, forms, comments,
footers) around an article whose container goes by many names, with some of the frame's
parts inside the article too, and with the faults of real pages: paragraphs and bold runs
that nobody closes, wrappers, comments and scripts between blocks.

Pages come in styles: named (tags, classes and ids tell what a part is), junk (classes are
made by a machine), bare (no classes) and plain (all containers are ``div``). Where names do
not tell, a frame's texts do: links, copyright lines, headings over comments, calls to buy or
to subscribe. So the labeller cannot live on names alone.
"""

from __future__ import annotations

import random
from html import escape

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch en ge ung sch lich eau tre qu ción os ar ll".split()
ARTICLES = ("article", "main", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.post-content", "div.main-content", "div.text", "article.post", "div#main", "section.article", "div.page-content", "div.body-text")
FRAMES = {
    "menu": ("nav", "div.menu", "ul.nav", "div#navigation", "nav.main-nav", "div.navbar", "div.breadcrumbs", "div.topbar", "nav.pagination", "div.toc-menu"),
    "header": ("header", "div#header", "div.site-header", "div.masthead", "div.page-header", "div.logo", "header.banner"),
    "footer": ("footer", "div#footer", "div.site-footer", "div.copyright", "footer.bottom", "div.legal"),
    "side": ("aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "aside.right", "div.related-posts", "div.recommended", "div.tags", "div.author-box"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "div.banner-ad", "section.promotion"),
    "notice": ("div.cookie", "div.notice", "div.cookie-banner", "div.consent", "div.alert", "div.popup", "div.gdpr", "div.newsletter", "div.subscribe", "section.notice"),
    "form": ("form", "form.search", "form#login", "div.form", "form.newsletter", "form.contact"),
    "comments": ("div.comments", "section#comments", "ol.comment-list", "div#disqus", "section.comments", "div.replies", "ul.commentlist", "div.comment", "section.discussion", "div.feedback", "div#respond", "div.thread", "section.reader-reactions", "div.talkback", "ul.responses"),
    "share": ("div.share", "div.social", "ul.social-links", "div.share-buttons"),
}
PHRASES = ("Home", "About us", "Contact", "Read more", "Subscribe now", "All rights reserved", "We use cookies to improve this site", "Reply", "Posted by", "Share this", "Log in", "Search", "Privacy policy", "Related articles", "Advertisement", "Sponsored")
NOISE = ("wrap", "clearfix", "container", "inner", "row", "col", "box", "block", "module", "grid", "u1", "x2")
#: What the texts of frames say where names say nothing; the first of a frame is always one of these.
CUES = {
    "menu": ("Home", "About us", "About", "Contact", "News", "Sports", "Products", "Services", "Blog", "Shop", "Archive", "Next page", "Previous", "Menu", "Skip to content"),
    "header": ("Welcome to our site", "The daily news", "Menu", "Log in", "Sign up", "Search", "Your account", "My site"),
    "footer": ("© 2024 All rights reserved", "Copyright 2019", "© Example Inc. 2021. All rights reserved.", "Terms of use", "Privacy policy", "Imprint", "Powered by a content system", "Contact us at the address below", "Copyright (c) 2020 the authors"),
    "side": ("Related articles", "Most read", "Popular posts", "Tags", "Recent posts", "You may also like", "About the author", "Recommended for you", "Categories", "See also"),
    "advert": ("Advertisement", "Sponsored", "Buy now and save 50%", "Special offer", "Limited time offer: order today", "Promoted content", "Click here for the best deals", "Ad"),
    "notice": ("We use cookies to improve this site", "This site uses cookies", "Accept all cookies", "Subscribe to our newsletter", "Sign up for our newsletter", "By continuing you agree to our privacy policy", "Please enable notifications", "I agree"),
    "form": ("Search", "Email address", "Your name", "Password", "Submit", "Send", "Log in", "Message", "Enter your email"),
    "comments": ("Comments", "3 comments", "Leave a comment", "Leave a reply", "Discussion", "12 responses", "Reader comments", "What do you think?", "Join the conversation"),
    "share": ("Share this", "Share on Facebook", "Tweet", "Follow us", "Print", "Email this page", "Like us"),
}
PEOPLE = ("anna", "bob", "maria k", "john d", "user42", "reader", "guest", "tom", "lee", "sara")
COMMON = "the of and to a in is that for was on are as with they be at one have this from or had by but not what all were we when your can said there use an each which she do how their if".split()
STYLES = ("named", "named", "named", "junk", "bare", "plain")
SEMANTIC = frozenset(("article", "main", "nav", "header", "footer", "aside", "section"))


def _words(rng: random.Random, n: int) -> str:
    out, start = [], True
    for _ in range(n):
        w = rng.choice(COMMON) if rng.random() < 0.25 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))
        out.append((w.capitalize() if start else w) + ("." if (start := rng.random() < 0.12) else "," if rng.random() < 0.08 else "") + (rng.choice(("&&&", "***", "###", "")) if rng.random() < 0.05 else ""))
    return " ".join(out)


class Page:
    """Collects markup, and for each block of text its label."""

    def __init__(self, seed: int) -> None:
        self.rng, self.html, self.labels = random.Random(seed), [], []
        self.style = self.rng.choice(STYLES)
        self.cued = self.style != "named"

    def open(self, name: str) -> str:
        rng = self.rng
        tag, mark, value = name.partition("." if "." in name else "#")
        mark = "" if not value else "." if "." in name else "#"
        classes = [value] if mark == "." else []
        if self.style == "plain" or (self.cued and rng.random() < 0.6):
            tag = "div" if tag in SEMANTIC else tag
        if self.style == "junk":
            classes, mark = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(3, 7))) for _ in range(rng.randrange(1, 3))], ""
            classes = [rng.choice(("css-", "sc-", "jsx-", "_", "")) + c for c in classes]
        elif self.style == "bare":
            classes, mark = [], ""
        elif rng.random() < 0.25:
            classes.append(rng.choice(NOISE))
        ident = f' id="{value}"' if mark == "#" else ""
        self.html.append(f"<{tag}{ident}" + (f' class="{" ".join(classes)}"' if classes else "") + ">")
        return f"</{tag}>"

    def block(self, tag: str, text: str, label: int, link: bool = False) -> None:
        body = f'<a href="/{self.rng.randrange(999)}">{escape(text)}</a>' if link else escape(text)
        fault = self.rng.random()
        if tag == "p" and not link and fault < 0.15:
            self.html.append(f"<p><b>{body}<br>")
        elif tag == "p" and not link and fault < 0.25:
            self.html.append(f"<p>{body}")
        else:
            self.html.append(f"<{tag}>{body}</{tag}>")
        self.labels.append(label)
        if self.rng.random() < 0.05:
            self.html.append(self.rng.choice(("<!-- ad 1 -->", "<script>var t='</p>';</script>", "<style>p{margin:0}</style>")))

    def phrase(self, kind: str, most: int, first: bool = False) -> str:
        rng = self.rng
        if self.cued and (first or rng.random() < 0.5):
            return rng.choice(CUES[kind])
        return rng.choice(PHRASES) if rng.random() < 0.4 else _words(rng, rng.randrange(1, most))

    def talk(self) -> None:
        """A reader's comment, with who wrote it and when."""
        rng = self.rng
        if rng.random() < 0.7:
            self.block(rng.choice(("p", "div", "h4")), f"{rng.choice(PEOPLE)} {rng.choice(('says:', 'wrote', '- 3 days ago', 'on 4 May 2021', 'replied', ''))}".strip(), 0)
        self.block(rng.choice(("p", "div", "p")), _words(rng, rng.randrange(2, 40)), 0)
        if rng.random() < 0.4:
            self.block("p", rng.choice(("Reply", "Report", "Like", "Quote")), 0, link=rng.random() < 0.5)

    def frame(self, kind: str) -> None:
        rng = self.rng
        close = self.open(FRAMES[kind][0] if rng.random() < 0.4 else rng.choice(FRAMES[kind]))
        phrase = lambda most, first=False: self.phrase(kind, most, first)
        listed = close in ("</ul>", "</ol>")
        if kind in ("menu", "share") or (kind in ("footer", "side") and rng.random() < 0.4):
            if kind in ("footer", "side") and self.cued and not listed:
                self.block(rng.choice(("h3", "p", "div")), phrase(4, True), 0)
            if not listed:
                self.html.append("<ul>")
            for _ in range(rng.randrange(1, 8)):
                self.block("li", phrase(4), 0, link=True)
            if not listed:
                self.html.append("</ul>")
        elif kind == "form":
            for i in range(rng.randrange(1, 4)):
                self.block(rng.choice(("label", "button", "p", "option")), phrase(5, i == 0), 0)
        elif listed:
            for i in range(rng.randrange(1, 5)):
                self.block("li", phrase(30, i == 0), 0)
        elif kind == "comments" and (self.cued or rng.random() < 0.5):
            if self.cued or rng.random() < 0.7:
                self.block(rng.choice(("h2", "h3", "h4", "p")), rng.choice(CUES[kind]), 0)
            for _ in range(rng.randrange(1, 4)):
                self.talk()
        elif rng.random() < 0.4:
            self.html.append(escape(phrase(20, True)))
            self.labels.append(0)
        else:
            if self.cued or rng.random() < 0.3:
                self.block(rng.choice(("h2", "h3", "h4")), phrase(5, True), 0)
            for _ in range(rng.randrange(1, 5 if kind == "comments" else 3)):
                self.block(rng.choice(("p", "div", "p")), phrase(60 if kind in ("comments", "side") and not self.cued else 25), 0)
        self.html.append(close)

    def article(self) -> None:
        rng = self.rng
        close = self.open(ARTICLES[0] if rng.random() < 0.3 else rng.choice(ARTICLES))
        if self.cued or rng.random() < 0.85:
            self.block(rng.choice(("h1", "h1", "h2")), _words(rng, rng.randrange(2, 14)), 1)
        for _ in range(rng.randrange(1, 14)):
            kind = rng.random()
            if kind < 0.7:
                self.block("p", _words(rng, rng.randrange(1, rng.choice((6, 60, 200)))), 1)
            elif kind < 0.78:
                self.block(rng.choice(("h2", "h3", "blockquote", "pre", "figcaption")), _words(rng, rng.randrange(1, 20)), 1)
            elif kind < 0.86:
                inner = self.open(rng.choice(("ul", "ol")))
                for _ in range(rng.randrange(1, 5)):
                    self.block("li", _words(rng, rng.randrange(1, 25)), 1)
                self.html.append(inner)
            elif kind < 0.9:
                self.html.append("<table>")
                for _ in range(rng.randrange(1, 3)):
                    self.html.append("<tr>")
                    for _ in range(rng.randrange(1, 4)):
                        self.block("td", _words(rng, rng.randrange(1, 6)), 1)
                    self.html.append("</tr>")
                self.html.append("</table>")
            else:
                self.frame(rng.choice(("advert", "share", "form", "notice", "side", "comments")))
        self.html.append(close)

    def whole(self) -> tuple[str, list[int]]:
        rng = self.rng
        self.html.append("<!DOCTYPE html><html><head><meta charset=utf-8>")
        self.block("title", _words(rng, 6), 0)
        self.html.append("</head><body>")
        wrap = self.open(rng.choice(("div", "div#page", "div.wrapper"))) if rng.random() < 0.4 else ""
        for kind in rng.sample(["menu", "header", "advert", "notice", "form", "side"], rng.randrange(1, 5)):
            self.frame(kind)
        self.article()
        for kind in rng.sample(["comments", "side", "advert", "footer", "form", "share", "menu"], rng.randrange(1, 5)):
            self.frame(kind)
        self.html.append(f"{wrap}</body></html>")
        return "".join(self.html), self.labels


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page, and 1 or 0 for each of its blocks in page order."""
    return Page(seed).whole()
