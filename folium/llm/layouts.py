"""Copies of a labelled page in other layouts, to learn from: the same texts under other tags and class names.

Where a page keeps its parts, and what they are called, differs from site to site; what is around the main text
is alike. A copy takes the page's own blocks, says of each part whether it is main text (attribute data-main), and
picks container, names and places by a seed, so that it is the same each time."""

import html
import random
from typing import TYPE_CHECKING, NamedTuple

if TYPE_CHECKING:
    from folium.llm.html_extraction import Page

#: Usual words in the class names of the parts of a page.
MAIN = "content article post entry main story body text copy blog page single prose markdown document detail field".split()
WRAPPER = "wrapper container page site layout row col inner outer wrap grid app root holder section block module box".split()
MENU = "nav menu navigation navbar breadcrumb breadcrumbs topbar links tabs toc pagination pager submenu toolbar categories skip".split()
HEADER = "header masthead branding logo top banner tagline hero".split()
FOOTER = "footer bottom copyright legal foot colophon credits imprint disclaimer".split()
SIDEBAR = "sidebar aside rail widget related recommended popular trending secondary more teaser promo latest archive tags author bio".split()
NOTICE = "cookie consent notice gdpr popup modal alert newsletter subscribe paywall overlay message warning privacy banner toast announcement".split()
ADVERT = "ad ads advert advertisement sponsor sponsored sponsored adsense promo promotion advertorial commercial dfp banner".split()
FORM = "form search login signup register contact feedback survey subscribe".split()
COMMENTS = "comments comment replies reply discussion respond thread disqus responses feedback reviews review commentlist".split()
SHARE = "share social sharing buttons follow tools meta".split()


class Parts(NamedTuple):
    """Texts of a page: blocks of the main text with their tags, and short ones from around it."""

    main: list[tuple[str, str]]
    other: list[str]


def parts(page: "Page") -> Parts:
    blocks: dict[int, tuple[int, list[str]]] = {}
    for at, block, text, _ in page.pieces:
        blocks.setdefault(block, (at, []))[1].append(text)
    main, other = [], []
    for at, texts in blocks.values():
        text = " ".join("".join(texts).split())
        if text and page.labels[at]:
            main.append((page.tags[at], text))
        elif text:
            other.append(text)
    return Parts(main, other)


class _Copy:
    def __init__(self, of: Parts, seed: int):
        self.pick, self.of = random.Random(seed), of
        words = [w for _, t in of.main for w in t.split()[:4000]] + [w for t in of.other for w in t.split()]
        self.words = words or [chr(97 + i % 26) * (1 + i * 7919 % 9) + "." * (i % 11 == 0) for i in range(500)]

    def chance(self, p: float) -> bool:
        return self.pick.random() < p

    def some(self, low: int, high: int) -> str:
        """A stretch of the page's words."""
        n = self.pick.randint(low, high)
        at = self.pick.randrange(max(1, len(self.words) - n))
        return html.escape(" ".join(self.words[at : at + n]), quote=False)

    def sentence(self, low: int, high: int) -> str:
        return self.some(low, high).rstrip(".,") + self.pick.choice([".", ".", ".", "!", "?"])

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.pick.randrange(99)}">{self.some(low, high)}</a>'

    def named(self, names: list[str]) -> str:
        """A class or id with one of the names, with others about it or not."""
        name = self.pick.choice(names)
        name = self.pick.choice([name, name, f"{self.pick.choice(WRAPPER)}-{name}", f"{name}-{self.pick.choice(WRAPPER)}", f"{name}{self.pick.randrange(9)}", f"x{self.pick.randrange(99)} {name}", f"{name}_{self.pick.choice(names)}"])
        return f' {self.pick.choice(["class", "class", "class", "id"])}="{name}"'

    def box(self, tags: list[str], names: list[str], inner: str, main: str = "0", bare: float = 0.15) -> str:
        """An element of a part: named by its tag, its class or both."""
        tag = self.pick.choice([*tags, "div", "div", "section"])
        named = "" if tag in tags and tag not in ("div", "section", "ul") and self.chance(0.5) or self.chance(bare) and tag in tags else self.named(names)
        return f'<{tag}{named} data-main="{main}">{inner}</{tag}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        each = [self.link() for _ in range(self.pick.randint(low, high))]
        return self.pick.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in each)}</ul>", " | ".join(each), " ".join(each), "".join(f"<div>{x}</div>" for x in each)])

    def menu(self) -> str:
        return self.box(["nav", "nav", "ul"], MENU, self.links())

    def header(self) -> str:
        name = self.pick.choice([self.link(), f"<h1>{self.some(1, 3)}</h1>", f"<p>{self.some(2, 6)}</p>", f"<div>{self.some(1, 3)}</div>"])
        return self.box(["header", "header"], HEADER, name + (f"<p>{self.some(3, 9)}</p>" if self.chance(0.4) else "") + (self.menu() if self.chance(0.5) else ""))

    def footer(self) -> str:
        said = f"&copy; {self.some(1, 4)}"
        inner = self.pick.choice([said, f"<p>{said}</p>", f"<p>{said} &middot; {self.sentence(3, 12)}</p>", f"{said} {self.sentence(4, 15)}"])
        return self.box(["footer", "footer"], FOOTER, inner + (self.links(2, 5) if self.chance(0.4) else "") + (f"<p>{self.sentence(8, 30)}</p>" if self.chance(0.3) else ""))

    def sidebar(self) -> str:
        inner = f"<h{self.pick.choice('234')}>{self.some(1, 4)}</h3>" + self.pick.choice([self.links(), f"<p>{self.sentence(5, 30)}</p>", "".join(f"<div><h4>{self.link(3, 8)}</h4><p>{self.sentence(5, 20)}</p></div>" for _ in range(3))])
        return self.box(["aside", "aside"], SIDEBAR, inner)

    def notice(self) -> str:
        inner = self.pick.choice([f"<p>{self.sentence(6, 30)}</p>", self.sentence(6, 30), f"<h3>{self.some(2, 5)}</h3><p>{self.sentence(6, 25)}</p>", f"<span>{self.sentence(6, 20)}</span> {self.link()}"])
        return self.box(["div"], NOTICE, inner + ("<button>OK</button>" if self.chance(0.5) else ""), bare=0)

    def advert(self) -> str:
        inner = self.pick.choice([self.sentence(3, 20), f"<p>{self.sentence(5, 25)}</p>", self.link(3, 9), f"<h4>{self.some(2, 6)}</h4><p>{self.sentence(4, 18)}</p>{self.link()}"])
        return self.box(["div", "aside"], ADVERT, inner, bare=0)

    def form(self) -> str:
        inner = f"<label>{self.some(1, 4)}</label><input>" + (f"<p>{self.sentence(4, 15)}</p>" if self.chance(0.6) else "") + (f"<div>{self.some(2, 6)}</div>" if self.chance(0.3) else "") + "<button>Go</button>"
        form = f'<form{self.named(FORM) if self.chance(0.5) else ""} data-main="0">{inner}</form>'
        return form if self.chance(0.6) else self.box(["div"], FORM, form, bare=0)

    def comments(self) -> str:
        def one() -> str:
            who = self.pick.choice([f"<b>{self.some(1, 2)}</b>", f"<h4>{self.some(1, 2)}</h4>", f"<div>{self.some(1, 3)}</div>", ""])
            text = "".join(f"<p>{self.sentence(4, 60)}</p>" for _ in range(self.pick.randint(1, 2))) if self.chance(0.8) else self.sentence(4, 60)
            tag = self.pick.choice(["div", "div", "li", "article", "p", "blockquote"])
            return f'<{tag}{self.named(COMMENTS[:3]) if self.chance(0.7) else ""} data-main="0">{who}{text}</{tag}>'

        inner = (f"<h3>{self.some(1, 3)}</h3>" if self.chance(0.7) else "") + "".join(one() for _ in range(self.pick.randint(1, 6)))
        inner = f"<ol>{inner}</ol>" if self.chance(0.2) else inner
        return self.box(["section", "div"], COMMENTS, inner + (self.form() if self.chance(0.3) else ""), bare=0)

    def share(self) -> str:
        return self.box(["div", "ul"], SHARE, self.pick.choice([self.links(2, 5), self.some(1, 4)]), bare=0)

    def around(self) -> list[str]:
        return [part() for part, p in ((self.sidebar, 0.5), (self.notice, 0.4), (self.advert, 0.5), (self.form, 0.3), (self.menu, 0.3), (self.comments, 0.4)) if self.chance(p)]

    def paragraph(self, tag: str, text: str) -> str:
        """A block of the main text as it was, or as another one."""
        words = text.split(" ")
        if self.chance(0.3) and len(words) > 6:
            at = self.pick.randrange(len(words) - 3)
            text = " ".join(words[:at]) + " \x00" + " ".join(words[at : at + 3]) + "\x01 " + " ".join(words[at + 3 :])
        text = html.escape(text, quote=False).replace("\x00", self.pick.choice(['<a href="/x">', "<b>", "<em>", "<span>"])).replace("\x01", "</a></b></em></span>")
        if tag.startswith("h") and tag[1:].isdigit():
            return f"<{tag}>{text}</{tag}>"
        kind = self.pick.random()
        if kind < 0.06 and len(words) > 8:
            half = len(words) // 2
            return self.pick.choice(["<ul>", "<ol>"]) + "".join(f"<li>{html.escape(' '.join(x), quote=False)}</li>" for x in (words[:half], words[half:])) + "</ul></ol>"
        if kind < 0.1:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.13:
            return f"<pre>{text}</pre>"
        if kind < 0.16:
            return f"<table><tr><td>{text}</td><td>{self.some(1, 3)}</td></tr></table>"
        if kind < 0.2:
            return f"<div>{text}</div>"
        if kind < 0.24:
            return f"<h2>{self.some(1, 6)}</h2><p>{text}</p>"
        if kind < 0.27:
            return f"<figure><img><figcaption>{self.some(3, 9)}</figcaption></figure><p>{text}</p>"
        return f"<p>{text}</p>"

    def whole(self) -> str:
        blocks = self.of.main or [("p", self.sentence(5, 80)) for _ in range(self.pick.randint(1, 12))]
        if self.chance(0.3):  # a short one
            blocks = blocks[: self.pick.randint(1, 3)]
        head = [b for b in blocks[:1] if b[0].startswith("h")]
        inner = [self.paragraph(*b) for b in blocks[len(head) :]]
        title = f"<h{self.pick.choice('1112')}>{html.escape(head[0][1] if head else self.some(2, 9), quote=False)}</h1></h2>" if self.chance(0.85) else ""
        if title and self.chance(0.15):
            title = f'<header data-main="1">{title}</header>'
        for part, p in ((self.share, 0.25), (self.advert, 0.25), (self.comments, 0.12), (self.sidebar, 0.08), (self.form, 0.05)):
            if self.chance(p):
                inner.insert(self.pick.choice([0, len(inner), len(inner) // 2]), part())
        core = title + "".join(inner)
        kind = self.pick.random()
        if kind < 0.12:
            core = f'<div data-main="1">{core}</div>'  # by nothing but its text
        elif kind < 0.8:
            core = self.box(["article", "main"], MAIN, core, "1", bare=0)
            if self.chance(0.4):
                core = self.box(["article", "main", "div"], MAIN, core, "1")
        else:
            core = f'<{self.pick.choice(["article", "main"])} data-main="1">{core}</article></main>'
        around = self.around()
        at = self.pick.randint(0, len(around))
        body = "".join(around[:at]) + core + "".join(around[at:])
        for _ in range(self.pick.choice([0, 0, 1, 1, 2])):
            body = f'<div{self.named(WRAPPER)} data-main="0">{body}</div>'
        lead = "".join(part() for part, p in ((self.header, 0.6), (self.menu, 0.6), (self.notice, 0.15)) if self.chance(p))
        return f'<html><head><title>{self.some(1, 6)}</title></head><body data-main="0">{lead}{body}{self.footer() if self.chance(0.8) else ""}</body></html>'


def dressed(of: Parts, seed: int) -> str:
    """The page in a layout of the seed."""
    return _Copy(of, seed).whole()
