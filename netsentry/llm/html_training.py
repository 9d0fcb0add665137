"""The small labelled table of the HTML classifier: invented pages, each with
the blocks that are its main text. Longer paragraphs are made from a rule."""

from __future__ import annotations


def _words(n: int, salt: int) -> str:
    """``n`` invented words; the same for the same arguments."""
    stems = "mora telin sadu kerro vanim olat brise tonda welk surin".split()
    return " ".join(stems[(k * k + 3 * k + salt) % 10] + "aeiou"[(k + salt) % 5] for k in range(n)).capitalize() + "."


def labelled_pages() -> list[tuple[str, set[str]]]:
    out = []
    sizes = [(60, 1, 25), (3, 90, 2), (40, 8, 120), (12, 30, 1), (1, 2, 3), (200, 15, 45)]
    for n, size in enumerate(sizes):
        title, body = _words(4 + n, n), [_words(k, n + 10 * j) for j, k in enumerate(size)]
        main = {title, *body}
        ad, foot = _words(5 + 7 * n, n + 50), _words(6 + 5 * n, n + 60)
        note, remark = _words(9 + 6 * n, n + 70), _words(14 + 9 * n, n + 80)
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        menu = "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in _words(6, n + 90).split()) + "</ul>"
        # 1: semantic tags, an advert before the article and a footer after it
        out.append((f"<html><head><title>{title}</title></head><body><nav>{menu}</nav><div class='ad'>{ad}</div>"
                    f"<article><h1>{title}</h1>{paragraphs}</article><footer>&copy; {foot}</footer></body></html>", main))
        # 2: main container, notice, sidebar, comments, form
        out.append((f"<body><header><h2>{note}</h2>{menu}</header><div class='cookie-notice'>{note}</div><main><h1>{title}</h1>"
                    f"{paragraphs}<section class='comments'><p>{remark}</p></section></main><aside><h3>{ad}</h3><p>{foot}</p></aside>"
                    f"<form><label>{ad}</label></form><p>{foot}</p></body>", main))
        # 3: an advert and related links inside the article
        out.append((f"<body><div id='menu'>{menu}</div><div class='post'><h1>{title}</h1><p>{body[0]}</p><div class='advert'>{ad}</div>"
                    f"<p>{body[1]}</p><p>{body[2]}</p><div class='related'>{menu}</div></div><div id='comments'><p>{remark}</p></div></body>", main))
        # 4: no semantic container: long blocks, few links
        if n % 2 == 0:
            text = [_words(k + 25, n + 5 * k) for k in size]
            out.append((f"<body><table><tr><td>{menu}</td><td>" + "".join(f"<p>{t}</p>" for t in text)
                        + f"</td></tr></table><p><a href='/'>{_words(4, n)}</a></p><p>{_words(5, n + 3)}</p></body>", set(text)))
    return out
