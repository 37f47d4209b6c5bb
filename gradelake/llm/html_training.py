"""Labelled pages for the page model, written by recipe after common public conventions of page templates.

Each recipe is a way to build sites: semantic elements, blog themes, content systems, grids, layout tables, newspapers, manuals, shops, forums, or plain
boxes. The labels are known because the pages are made: every block is written with its kind, `article` or something around it. Names of parts
are often left out or replaced by ones that say nothing, so that the model also learns from structure, position and wording.
"""

from __future__ import annotations

import random
import string

#: What the parts of a page are called, by kind, and by words that stand in them, in English, German, French and Spanish.
NAMES = {
    "article": "article post entry content story body main text page node field document prose markdown",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav pagination pager toc tabs",
    "header": "header masthead topbar top banner branding logo hero",
    "footer": "footer bottom colophon legal copyright imprint",
    "sidebar": "sidebar side aside widget related recommended popular trending tags rail secondary column",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay paywall disclaimer announcement message",
    "advert": "ad ads advert advertisement sponsored promo adsense promotion sponsor",
    "comments": "comments comment commentlist reply replies discussion responses thread feedback disqus",
    "form": "form search login subscribe signup contact newsletter respond register",
    "share": "share sharing social follow author bio",
}
CUES = {
    "menu": "home about contact menu archive archives next previous sitemap faq startseite kontakt accueil inicio contacto",
    "footer": "copyright reserved rights terms imprint impressum powered datenschutz mentions droits derechos reservados",
    "sidebar": "related popular trending recent latest categories tags recommended read mehr lire voir más relacionados",
    "notice": "cookie cookies consent accept privacy policy javascript browser enable akzeptieren accepter aceptar",
    "advert": "advertisement sponsored ad ads advert offer sale discount buy deal anzeige werbung publicité publicidad",
    "comments": "comment comments reply replies responses said says wrote ago kommentar kommentare antworten commentaire commentaires répondre comentario comentarios responder",
    "form": "search subscribe newsletter sign signup login register email e-mail address password username submit name published required suche anmelden adresse recherche buscar correo",
    "share": "share tweet facebook twitter whatsapp linkedin pinterest follow teilen partager compartir",
}
#: Short texts as sites have them. {n} is a number, {w} a name, {t} a run of words.
SAYINGS = {
    "menu": ["Home", "About us", "Contact", "Next", "Previous page", "Archives {n}", "Menu", "Startseite", "Accueil", "Inicio"],
    "footer": ["Copyright {n} {w}. All rights reserved.", "© {n} {w}", "Terms of use", "Powered by {w}", "Impressum", "Mentions légales", "Todos los derechos reservados", "© {w} · {t}"],
    "sidebar": ["Related posts", "Most popular", "Recent posts", "You may also like", "Tags: {w}, {w}", "Read more: {t}", "Trending now", "Mehr zum Thema", "Lire aussi"],
    "notice": ["We use cookies to improve your experience. By continuing you accept our privacy policy.", "This site uses cookies. {t}", "Please enable JavaScript in your browser.", "Accept all", "Diese Seite verwendet Cookies.", "Nous utilisons des cookies."],
    "advert": ["Advertisement", "Sponsored", "Buy now and save {n} %", "Special offer: {t}", "Anzeige", "Publicité"],
    "comments": ["{n} comments", "Comments", "Leave a reply", "{w} says:", "{w} wrote {n} days ago", "Reply", "Kommentare", "{n} commentaires", "Comentarios", "{w}, {n} hours ago"],
    "form": ["Your email address will not be published.", "Required fields are marked *", "Subscribe to our newsletter", "Sign up", "Log in", "Search", "Email", "Name", "Submit", "Enter your email address to subscribe. {t}", "Post comment"],
    "share": ["Share this", "Share on Facebook", "Tweet", "Follow us", "Teilen", "Partager"],
}
#: Each recipe: how an article is wrapped, outermost first, as tag or tag.name; and the tag that other parts usually have.
RECIPES = {
    "semantic": (["main", "article"], {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}),
    "bare article": (["article"], {"menu": "nav", "footer": "footer", "header": "header", "form": "form", "notice": "aside", "sidebar": "aside"}),
    "blog": (["div.content", "div.post", "div.entry-content"], {"sidebar": "div", "comments": "ol", "menu": "ul"}),
    "system": (["div.region-content", "div.node", "div.field-body"], {"menu": "ul", "comments": "section", "footer": "footer"}),
    "grid": (["div.container", "div.row", "div.col", "div.article-body"], {"menu": "nav", "footer": "footer", "sidebar": "aside", "header": "header"}),
    "layout table": (["table", "tr", "td.main"], {"menu": "td", "footer": "td"}),
    "newspaper": (["main", "div.story-body"], {"sidebar": "aside", "menu": "nav", "advert": "aside"}),
    "manual": (["div.document", "div.body", "section"], {"menu": "div", "form": "form"}),
    "forum": (["div.page", "div.thread", "div.post-body"], {"comments": "div", "footer": "div"}),
    "boxes": (["div", "div"], {}),
}
SYLLABLES = "ba be bi bo ca ce co da de di do fa fe fi ga ge gu la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi za ö ä ü é è ç ñ ß ing er en tion".split()


class _Writer:
    def __init__(self, seed: int, recipe: str):
        self.r = random.Random(f"{recipe}:{seed}")
        self.wraps, self.tags = RECIPES[recipe]
        self.kinds: dict[str, str] = {}
        #: How often parts go by telling names on this page.
        self.telling = self.r.choice([0.0, 0.5, 0.9, 1.0])

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        r = self.r
        noisy = r.random() < 0.08
        out = [self.word() for _ in range(r.randint(low, high))]
        for i in range(len(out)):
            if r.random() < 0.12:
                out[i] += r.choice([",", ",", ".", ";"])
            elif r.random() < 0.02:  # cue words stand in articles too
                out[i] = r.choice(CUES[r.choice(list(CUES))].split())
            elif r.random() < 0.02:
                out[i] = str(r.randrange(3000))
            elif noisy:
                out[i] += r.choice(string.punctuation) * r.choice([1, 1, 3])
        return " ".join(out).capitalize()

    def block(self, text: str, kind: str) -> str:
        """`text` with its kind noted; a text of another kind's gets another word."""
        text = " ".join(text.split())
        while self.kinds.setdefault(text, kind) != kind:
            text += " " + self.word()
        return text

    def prose(self, low: int, high: int, kind: str, stop: bool = True) -> str:
        return self.block(self.words(low, high) + ("." if stop else ""), kind)

    def saying(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.25 and kind not in ("notice", "advert"):
            return self.prose(1, 8, kind, r.random() < 0.3)
        t = r.choice(SAYINGS[kind]).replace("{n}", str(r.randrange(1, 2030))).replace("{t}", self.words(2, 8))
        while "{w}" in t:
            t = t.replace("{w}", self.word().capitalize(), 1)
        return self.block(t, kind)

    def named(self, kind: str) -> str:
        r = self.r
        if r.random() >= self.telling:
            return r.choice(["", f' class="{self.word()}-{r.randrange(99)}"', f' class="css-{self.word()}"', f' id="{self.word()}"'])
        name = r.choice(NAMES[kind].split())
        if r.random() < 0.4:
            name = r.choice([f"site-{name}", f"{name}-box", f"{name}_wrap", f"{name}{self.word().capitalize()}", f"main-{name}", f"{name} block"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def part(self, kind: str, inside: str, name: str | None = None) -> str:
        tag = self.tags.get(kind, "div")
        return f"<{tag}{self.named(kind) if name is None else name}>{inside}</{tag}>"

    def links(self, kind: str) -> str:
        r = self.r
        one = [f'<a href="/{self.word()}">{self.saying(kind) if r.random() < 0.5 else self.prose(1, 6, kind, False)}</a>' for _ in range(r.randint(2, 9))]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>", " | ".join(f"<span>{x}</span>" for x in one[:1]) if len(one) < 3 else "".join(f"<div>{x}</div>" for x in one)])

    def heading(self, kind: str, level: str = "2345") -> str:
        tag = self.r.choice(["h" + self.r.choice(level)] * 3 + ["p", "div", "strong"])
        return f"<{tag}>{self.saying(kind) if kind != 'article' else self.prose(2, 9, kind, False)}</{tag}>"

    def reader(self) -> str:
        r = self.r
        who = r.choice([f"<b>{self.word().capitalize()}</b>", f"{self.word().capitalize()} says:", f"{self.word().capitalize()}, {r.randrange(1, 30)} days ago", f"{self.word().capitalize()} at {r.randrange(24)}:{r.randrange(10, 60)}"])
        who = f"<{(t := r.choice(['div', 'p', 'span', 'cite']))}>{self.block(who.replace('<b>', '').replace('</b>', ''), 'comments')}</{t}>"
        said = "".join(f"<p>{self.prose(*r.choice([(2, 10), (8, 40), (20, 70)]), 'comments')}</p>" for _ in range(r.choice([1, 1, 2])))
        reply = f"<a href='#r'>{self.block('Reply', 'comments')}</a>" if r.random() < 0.4 else ""
        return f"<{(t := r.choice(['li', 'div', 'div', 'article']))}{self.named('comments')}>{who}{said}{reply}</{t}>"

    def around(self, kind: str) -> str:
        """A part that is not the article."""
        r = self.r
        long = lambda: "".join(f"<p>{self.prose(*r.choice([(4, 14), (10, 45)]), kind)}</p>" for _ in range(r.randint(1, 3)))
        if kind == "menu":
            return self.part(kind, self.links(kind))
        if kind == "comments":
            return self.part(kind, (self.heading(kind) if r.random() < 0.8 else "") + "".join(self.reader() for _ in range(r.randint(1, 5))) + (self.around("form") if r.random() < 0.4 else ""))
        if kind == "form":
            inside = f"<label>{self.saying(kind)}</label><input name='q'><button>{self.saying(kind)}</button>"
            inside = (f"<p>{self.saying(kind)}</p>" if r.random() < 0.6 else "") + inside
            return self.part(kind, (self.heading(kind) if r.random() < 0.4 else "") + (f"<form>{inside}</form>" if r.random() < 0.7 else inside))
        if kind == "header":
            inside = r.choice([f"<h1>{self.prose(1, 6, kind, False)}</h1>", f"<p>{self.prose(2, 12, kind)}</p>", f"<a href='/'>{self.prose(1, 3, kind, False)}</a>"])
            return self.part(kind, inside + (self.links("menu") if r.random() < 0.3 else ""))
        if kind in ("footer", "share"):
            if self.tags.get(kind) == kind and r.random() < 0.5:
                return self.part(kind, r.choice(["", "&copy; ", "&copy; site &middot; "]) + self.prose(2, 40, kind))
            return self.part(kind, f"<p>{self.saying(kind)}</p>" * (r.random() < 0.7) + (self.links(kind) if r.random() < 0.5 else self.saying(kind)))
        if kind == "sidebar":
            return self.part(kind, "".join((self.heading(kind) if r.random() < 0.7 else "") + r.choice([self.links(kind), long()]) for _ in range(r.randint(1, 3))))
        name = self.named(kind)
        plain = [self.saying(kind), f"<p>{self.saying(kind)}</p>", self.saying(kind) + f"<button>{self.saying(kind)}</button>", f'<a href="/x">{self.saying(kind)}</a>']
        # prose under a name that says nothing would be an article by all that can be seen
        told = self.tags.get(kind) == "aside" or any(n in name for n in NAMES[kind].split())
        inside = r.choice([*plain, self.prose(3, 40, kind), self.prose(3, 40, kind), long()] if told else plain)
        return self.part(kind, inside, name)

    def paragraph(self) -> str:
        r, kind = self.r, self.r.random()
        prose = lambda low, high, stop=True: self.prose(low, high, "article", stop)
        if kind < 0.68:
            t = prose(*r.choice([(1, 4), (4, 14), (12, 60), (12, 60), (40, 150)]))
            words = t.split(" ")
            if len(words) > 6 and r.random() < 0.4:
                words[3] = f"<{(i := r.choice(('b', 'i', 'em', 'a href=/y', 'span', 'code')))}>{words[3]}</{i.split()[0]}>"
            t = " ".join(words)
            if r.random() < 0.06:
                return f"{t}<br><br>"
            return f"<p>{t}</p>" if r.random() < 0.85 else f"<p>{t}"
        if kind < 0.78:
            return f"<h{(h := r.choice('234'))}>{prose(2, 9, False)}</h{h}>"
        if kind < 0.86:
            return f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{prose(3, 25)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>"
        if kind < 0.91:
            return f"<blockquote><p>{prose(8, 40)}</p></blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{prose(1, 4, False)}</td><td>{prose(1, 6, False)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        return r.choice([f"<div>{prose(10, 60)}</div>", f"<pre>{prose(5, 30)}</pre>", f"<figure><figcaption>{prose(3, 12)}</figcaption></figure>"])

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{self.prose(2, 14, 'article', r.random() < 0.4)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 4, 7, 12))):
            out.append(self.paragraph())
            if r.random() < 0.1:
                out.append(self.around(r.choice(["advert", "advert", "sidebar", "notice", "share", "form"])))
        if r.random() < 0.2:
            out.append(self.around(r.choice(["comments", "share", "form", "sidebar"])))
        inside = "".join(out)
        for wrap in reversed(self.wraps):
            tag, _, name = wrap.partition(".")
            if not name or r.random() >= self.telling:
                named = "" if name == "" and r.random() < 0.6 else self.named("article")
            else:
                named = f' class="{name}"'
            inside = f"<{tag}{named}>{inside}</{tag}>"
            if tag not in ("tr", "table", "td") and r.random() < 0.12:
                inside += self.around(r.choice(["sidebar", "comments", "share", "advert"]))
        return inside

    def page(self) -> str:
        r = self.r
        before = "".join(self.around(k) for k in ("notice", "header", "menu", "advert", "form", "menu", "sidebar") if r.random() < 0.35)
        after = "".join(self.around(k) for k in ("share", "advert", "comments", "form", "sidebar", "menu", "notice", "footer") if r.random() < 0.4)
        body = before + (self.article() if r.random() < 0.95 else "") + after
        if r.random() < 0.5:
            body = f"<div{self.named('article') if r.random() < 0.3 else ''}>{body}</div>"
        head = f"<head><title>{self.word()}</title><style>.{self.word()}{{color:red}}</style><script>if (a < b) {{ document.write('<b>' + {self.word()}) }}</script></head>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def labelled_page(seed: int, recipe: str | None = None) -> tuple[str, dict[str, str]]:
    """(html, {text of a block: its kind}) of a page by `recipe`, or by the one whose turn it is."""
    w = _Writer(seed, recipe or list(RECIPES)[seed % len(RECIPES)])
    return w.page(), w.kinds
