"""Generated catalogue pages with knobs, and a demonstration on them."""

from __future__ import annotations

import random

from weftline.operators.repair import repair
from weftline.plans.api import render_repair
from weftline.sources.html import parse
from weftline.sources.specs import Field, Spec

SPEC = Spec(
    "catalogue", "https://shop.example/list",
    {"title": Field(".title"), "price": Field(".cost", "number", min=1), "tags": Field("li", "list", min_items=2)},
    row=".item", rows_min=2, rows_max=400,
)


def catalogue(rows: int = 3, seed: int = 1, row_class: str = "item", cost: str = '<span class="cost">{}</span>', scale: float = 1.0, pairs: bool = False, stars: bool = False, drop: str = "") -> str:
    """A page of records; ``cost`` is the markup around a price, empty for none."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        price = f"${round((10 + rnd.randrange(90)) * scale, 2):,.2f}"
        parts = {
            "title": f'<h3 class="title">Thing {chr(65 + i % 26)}{i}</h3>',
            "cost": cost.format(price) if cost else "",
            "stars": f'<em class="stars">{3 + i % 3}.{i % 10}</em>' if stars else "",
            "tags": "<ul>" + "".join(f"<li>tag {rnd.randrange(50)} of {i}" for _ in range(2 + i % 3)) + "</ul>",
        }
        out.append(f'<div class="{row_class}">' + "".join(v for k, v in parts.items() if k != drop) + "</div>")
    if pairs:
        inner = [x.replace("<div", "<article", 1)[:-6] + "</article>" for x in out]
        out = [f'<section class="duo">{"".join(inner[k : k + 2])}</section>' for k in range(0, rows, 2)]
    return f'<html><head><title>Shop</title><script>var x = "<div class=item>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav><main>{"".join(out)}</main><footer>&copy; Shop</footer></body></html>'


def run_demo() -> int:
    """A price that moved is followed; a price that is gone is not invented."""
    archive = [("2024-01-01", parse(catalogue()))]
    moved = repair(SPEC, parse(catalogue(cost='<b data-testid="cost-value">{}</b>', scale=1.1)), archive)
    gone = repair(SPEC, parse(catalogue(cost="", stars=True)), archive)
    print("price moved:", render_repair(moved), "price gone:", render_repair(gone), sep="\n")
    return int(not moved.fixes or bool(gone.fixes))
