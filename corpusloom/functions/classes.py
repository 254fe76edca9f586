"""Character classes and word lists that several functions share. All patterns run in Java's and RE2's dialects."""

from __future__ import annotations

#: White space as Python's str.split sees it; the bare class of either dialect is ASCII.
SPACE_SET = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, NOT_SPACE = f"[{SPACE_SET}]", f"[^{SPACE_SET}]"
INLINE_SPACE = "[" + SPACE_SET.replace(r"\t-\r", r"\t\x0b-\r") + "]"
#: The same set as characters, for trimming and translating without a pattern.
SPACES = "".join(chr(c) for r in ((9, 13), (28, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288)) for c in range(r[0], r[1] + 1))
#: The set of NOT_SPACE as ranges, ASCII first: Java tests a negated class range by range, which takes four times as long.
VISIBLE = (
    r"[!-~\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}"
    r"\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}]"
)
WORD = r"[\p{L}\p{N}_]"
NUMBER = r"[0-9]+(?:[.,/:\-][0-9]+)*"

#: Abbreviations that end with a dot inside a sentence.
ABBREVIATIONS = (
    "tp", "tx", "tt", "ths", "ts", "pgs", "gs", "bs", "ks", "ls", "cn", "q", "p", "h",
    "mr", "mrs", "ms", "dr", "st", "no", "vs", "e.g", "i.e", "ubnd", "hđnd", "tw",
)
#: Words of negation, and pairs with one of them that do not negate.
NEGATIONS = ("không", "chưa", "chẳng", "chả", "đừng", "chớ")
NOT_NEGATING = (
    ("hàng", "không"), ("phòng", "không"), ("không", "khí"), ("không", "gian"), ("không", "phận"),
    ("không", "quân"), ("không", "trung"), ("không", "lưu"), ("không", "chiến"), ("không", "kích"),
    ("không", "vận"), ("không", "ảnh"),
)
#: Common family and given names.
NAMES = frozenset("""
nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đinh trịnh đoàn lâm mai lương tạ tô
châu quách triệu khổng thái kiều cao hà vương
lan hùng dũng tuấn hương hằng trang linh thảo huyền nga nhung oanh phương quyên quỳnh thúy thủy tâm thu
loan liên hạnh hiền hồng hải hiếu hiệp hoa hòa hoà huy hưng khánh khoa khôi kiên long luân
mạnh minh my mỹ nam nghĩa ngọc nhân nhi phong phúc phước quân quang quốc sơn tài thắng thành thanh
thịnh thông thư trí trinh trung tú tùng tuyết uyên vân việt vinh vy xuân yến đạt đức duy giang
hậu hiển khang kim lộc lực ly na ninh phát phi phượng quý sang sinh tân thiện
thơ thuận thương tiến toàn trâm trọng tuệ tường văn yên
""".split())
