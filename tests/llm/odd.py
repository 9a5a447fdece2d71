"""Texts that the training-data operators have to get right."""

TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  a", "a  ", "a  b", "a \n  b", "\n\n a\n", "a\t b", "don't I'll we've",
    "<|endoftext|>", "x<|endoftext|>y <|startoftext|> z", "<s> </s> <unk>", "a▁b ▁ c▁", "naïve café ÀÉÎ", "ß ſ İ I ı Σας ΣΑΣ", "é ́ áb",
    "日本語 の テキスト。", "😀😀 👩‍👩‍👧 x", "\x1c a\x1fb \x85 \xa0 c", "a　b  c", "1234 5,678.90%", "</w> a</w>b", "\u0000 nul", "ab" * 700, "é" * 900 + "!" * 300,
    "Abc" * 3000 + " tail", "the " * 4000, "x" * 5000, " " * 300, "THE end.\nThe end.",
]
