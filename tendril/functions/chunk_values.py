"""Bullets, in the order in which they are tried."""

# (pattern, name) of the bullets that cut chunks.
BULLETS = (
    ("[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\\.", "로마자"),
    ("\\d{1,2}\\.", "숫자"),
    ("[가-하]\\.", "한글"),
    ("\\d{1,2}\\)", "반괄호 숫자"),
    ("[가-하]\\)", "반괄호 한글"),
    ("\\(\\d{1,2}\\)", "양괄호 숫자"),
    ("\\([가-하]\\)", "양괄호 한글"),
    ("[①-⑳]", "원문자"),
    ("[□■]", "네모"),
    ("[○●◦ㅇ]", "원"),
)

# Bullets that an inventory looks for, and those assumed where it finds none.
INVENTORY = ("□", "\uf000", "○", "ㅇ", "◦", "▸", "▶", "●", "-", "ㆍ", "※", "\\d+\\.", "[가-하]\\.", "\\d+\\)", "[가-하]\\)", "[①②③④⑤⑥⑦⑧⑨⑩]", "\\(\\d+\\)", "\\([가-하]\\)")
ASSUMED = ("□", "\uf000", "◦", "-")

# What a header loses before it is compared: its number, the signs before it, and what stands in brackets.
NUMBER = "^([가-하a-zA-Z0-9]+[\\.\\)\\]](?U:\\s*))"
SIGNS = "^#+(?U:\\s*)"
ASIDE = "\\(.*?\\)|\\[.*?\\]|託.*?〕|〈.*?〉"
# A line that looks like one of a table of contents, which is no header.
LEADERS = "(?U)\\.{2,}|·{2,}|\\s+\\d+\\s*$"

# Words in a title, in the order in which they are looked for, and the topic that they tell; entries that are left out.
TITLE_TOPICS = (("평가기준", "평가|사업자 선정|배점"), ("요구사항", "요구사항|제안요청사항"), ("개요", "개요|추진 배경|목적|범위|추진 내용|현황"))
OTHER_TOPIC = "기타"
APPENDED = "붙임|별지|서식"
# End of the fixed values; what follows is this library's own.

#: An entry of a table of contents: a title, leaders or a gap, and a page.
ENTRY = "^\\s*(?:#+\\s*)?(\\S.*?)(?:\\s*(?:[.·…‥⋯]{2,}|…)\\s*|\\t\\s*|\\s{2,})(\\d{1,4})\\s*$"
#: The end of any entry.
PAGE_END = "\\d\\s*$"
#: Styles of numbering, in the order in which they are tried.
NUMBERING = ("[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[.)]?\\s", "[IVX]+\\.\\s", "제\\s*\\d+\\s*[편장]", "제\\s*\\d+\\s*절", "\\d+\\.\\d+\\.\\d+", "\\d+\\.\\d+", "\\d+\\.", "[가-하]\\.", "[A-Z]\\.", "\\d+\\)", "[가-하]\\)", "\\(\\d+\\)", "\\([가-하]\\)", "[①-⑳]", "[★※]", "[□■]", "[○●◦ㅇ]")
#: A number of any style ahead of a title.
TITLE_NUMBER = f"^(?:{'|'.join(NUMBERING)})[.)]?\\s*"
