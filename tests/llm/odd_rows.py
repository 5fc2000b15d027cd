"""Texts that every operator has to take, and the rows as brute-force versions see them."""

ODD_TEXTS = [
    None, "", " ", "a", "Same text here.", "Same text here.", "same TEXT here.", "naïve café — 東京 😀\u0000▁ x",
    "12 <|endoftext|> don't\r\n\t  we'll  ", "word " * 3000, "x" * 20_000, " 　 \n\n", "Ёлка и снег", "\x1c\x85 odd\x0bspace",
]


def plain(docs):
    """(doc_id, text) pairs, null texts as empty ones."""
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
