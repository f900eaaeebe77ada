"""Labelled pages to train the extractor on: layouts of usual kinds, filled with invented sentences.

No labelled page is among the given tables, so pages are made by rule with a fixed seed: each has an article in one of several layouts and boilerplate of the kinds
that the extractor must leave out.  A page is a list of (html, is_article) pieces; a piece with text is one leaf block.
"""

from __future__ import annotations

import random

SYLLABLES = "an ba cor de el fi ga ho in jo ka lu men no or pe qui ro sa ti ur ve wa xi yo zu th er on re st é ü ñ".split()
#: Kinds of boilerplate and the names that pages give them.
KINDS = {
    "menu": "nav navbar navigation menu main-menu topnav site-nav breadcrumb breadcrumbs nav-links toc-menu mainMenu",
    "head": "header site-header masthead banner top-bar logo branding page-header topbar",
    "foot": "footer site-footer colophon copyright bottom footer-links legal page-footer",
    "side": "sidebar side aside widget widget-area rail right-rail secondary related related-posts recommended popular trending more-stories read-next teaser",
    "note": "cookie cookie-banner cookie-notice consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall promo-bar announcement disclaimer",
    "ad": "ad ads advert advertisement sponsored sponsor promo promoted banner-ad ad-slot adsense commercial ad-container adBox",
    "form": "form search search-form login contact-form feedback poll survey comment-form register",
    "talk": "comments comment comment-list comment-body reply replies responses discussion disqus reader-comments user-comments thread commentText",
    "share": "share social social-links share-bar sharing follow tags tag-list pagination pager prev-next author-box byline-links",
}
GOOD = "article content main entry-content post-content article-body story post body-text main-content text page-content articleBody post-body entry story-body single".split()
WRAP = "container wrapper row col inner outer page site layout grid block section clearfix box".split()
SAYS = {
    "note": ["We use cookies to improve this site.", "Accept all", "Subscribe to our newsletter", "Sign up for free updates today!", "This site uses cookies. Learn more"],
    "form": ["Search", "Your name", "E-mail", "Send", "Log in", "Leave a reply"], "foot": ["© 2024 All rights reserved", "Privacy policy", "Terms of use", "Imprint"],
    "share": ["Share", "Tweet", "Previous", "Next", "Filed under"], "ad": ["Advertisement", "Sponsored content", "Buy now and save 20%!"],
    "talk": ["3 comments", "Reply", "Great post, thanks!", "Posted by"], "menu": ["Home", "About", "Contact", "News"], "side": ["Related articles", "Most read", "You may also like"], "head": ["Welcome"],
}


def labelled_pages(count: int = 420, seed: int = 3) -> list[list[tuple[str, bool]]]:
    rng = random.Random(seed)
    return [_page(rng) for _ in range(count)]


def _words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def _sentences(rng, most):
    out = []
    odd = rng.random() < 0.12
    for _ in range(rng.randint(1, most)):
        w = _words(rng, rng.randint(1, 22))
        if odd:
            w = [x + rng.choice(["###", "%%%", " |", "!!", "$$$"]) for x in w]
        if rng.random() < 0.4 and len(w) > 4:
            w[len(w) // 2] += ","
        out.append(" ".join(w).capitalize() + rng.choice("....?!"))
    return " ".join(out)


def _open(rng, tag, names):
    key = rng.choice(["class", "class", "id"])
    name = rng.choice(names) if names else ""
    if name and rng.random() < 0.3:
        name = f"{rng.choice(WRAP)} {name}" if key == "class" else name
    return f'<{tag} {key}="{name}">' if name else f"<{tag}>"


def _article(rng):
    parts = [(f"<h1>{' '.join(_words(rng, rng.randint(1, 9))).capitalize()}</h1>", True)] if rng.random() < 0.8 else []
    for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
        r = rng.random()
        text = _sentences(rng, rng.choice([1, 1, 3, 6]))
        if r < 0.72:
            link = f' <a href="/x">{" ".join(_words(rng, 2))}</a> ' if rng.random() < 0.2 else ""
            parts.append((f"<p>{text}{link}{'</p>' if rng.random() < 0.9 else ''}", True))
        elif r < 0.8:
            parts.append((f"<h2>{' '.join(_words(rng, 4)).capitalize()}</h2>", True))
        elif r < 0.87:
            parts += [("<ul>", None), *[(f"<li>{_sentences(rng, 1)}</li>", True) for _ in range(rng.randint(2, 5))], ("</ul>", None)]
        elif r < 0.91:
            parts.append((f"<blockquote><p>{text}</p></blockquote>", True))
        elif r < 0.95:
            parts += [("<table><tr>", None), *[(f"<td>{' '.join(_words(rng, 2))}</td>", True) for _ in range(4)], ("</tr></table>", None)]
        elif r < 0.97:
            parts.append((f"<pre>{text}</pre>", True))
        else:
            parts.append((f"<p><b>{text}<br>", True))
        if rng.random() < 0.05:
            parts += _boiler(rng, rng.choice(["ad", "note", "share", "side"]))
    return parts


def _boiler(rng, kind):
    tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "note": "div", "ad": "div", "talk": "section", "share": "div"}[kind]
    plain = rng.random()
    if plain < 0.25:
        start = f"<{tag}>" if tag not in ("div", "section") else _open(rng, tag, KINDS[kind].split())
    elif plain < 0.9:
        tag = tag if rng.random() < 0.4 else rng.choice(["div", "div", "section", "ul"] if kind in ("menu", "share", "side") else ["div", "div", "section"])
        start = _open(rng, tag, KINDS[kind].split())
    else:
        role = {"menu": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "form": "search", "note": "dialog"}.get(kind, kind)
        start = f'<div role="{role}">'
        tag = "div"
    parts = [(start, None)]
    for _ in range(rng.randint(1, 5)):
        r, said = rng.random(), rng.choice(SAYS[kind])
        words = " ".join(_words(rng, rng.randint(1, 4)))
        if kind in ("menu", "share") or kind in ("side", "foot", "head") and r < 0.5:
            parts.append((rng.choice([f'<li><a href="/a">{words if r < 0.4 else said}</a></li>', f'<div><a href="/b">{words}</a></div>']), False))
        elif kind == "form":
            parts.append((f"<label>{said}</label><input name=q>", False))
        elif r < 0.35:
            parts.append((f"<p>{said}</p>", False))
        else:
            parts.append((f"<p>{_sentences(rng, 3 if kind in ('talk', 'side', 'note') else 2)}</p>" if r < 0.8 else f"<div>{_sentences(rng, 2)}</div>", False))
    return [*parts, (f"</{tag}>", None)]


def _page(rng):
    parts = [("<html><head><title>x</title><script>var a='<p>'</script></head><body>", None)]
    for kind in ("note", "head", "menu", "ad"):
        if rng.random() < 0.55:
            parts += _boiler(rng, kind)
    if rng.random() < 0.3:
        parts.append((f"<div>{_sentences(rng, 2)}</div>" if False else f'<div class="{rng.choice(KINDS["ad"].split())}">{_sentences(rng, 3)}</div>', False))
    style = rng.random()
    start, end = (("<article>", "</article>") if style < 0.35 else ("<main>", "</main>") if style < 0.45 else (_open(rng, "div", GOOD), "</div>") if style < 0.85
                  else (_open(rng, "div", WRAP), "</div>") if style < 0.95 else ("", ""))
    parts.append((start, None))
    if rng.random() < 0.15:
        parts += [("<header>", None), (f"<h1>{' '.join(_words(rng, 5))}</h1>", True), ("</header>", None)]
    parts += _article(rng)
    if rng.random() < 0.2:
        parts += _boiler(rng, rng.choice(["talk", "share"]))
    parts.append((end, None))
    for kind in ("share", "talk", "side", "form", "foot"):
        if rng.random() < 0.5:
            parts += _boiler(rng, kind)
    if rng.random() < 0.6:
        parts.append((f"<footer>&copy; {rng.choice(['x.example.com', 'Site'])} &middot; {_sentences(rng, 2)}</footer>", False))
    return parts
