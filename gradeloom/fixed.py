"""Fixed values.

Everything in this file must equal the values the assessment product uses, or
results would differ: word lists, labels, limits, and text patterns.
"""

# Whitespace as JavaScript defines it (Java's \s is ASCII only).
_SPACES = [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
ALL_SPACES = "".join(map(chr, _SPACES))
_SPACE_CLASS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The first half of the intersection rejects ordinary letters with one test.
WS = rf"[[^!-~\u3001-\ufefe]&&[{_SPACE_CLASS}]]"
NON_WS = f"[^{_SPACE_CLASS}]"

# Answer labels, half and full width.
LABEL = "[A-GＡ-Ｇ]"
LABEL_ANY_CASE = "[A-Ga-gＡ-Ｇａ-ｇ]"
LABEL_FROM = "abcdefgａｂｃｄｅｆｇＡＢＣＤＥＦＧ"
LABEL_TO = "ABCDEFGABCDEFGABCDEFG"
TRUE_MARK, FALSE_MARK = "√", "×"
TRUE_TEXT, FALSE_TEXT = "正确", "错误"
DOT = "[、.．]"

# Exam text headings.
NO_CHAPTER = "未分章"
SECTION_LABEL = {"single": "单选题", "multiple": "多选题", "judgement": "判断题"}
ANSWER_TABLE_SUFFIX = "答案表"
INLINE_JUDGEMENT_SOURCE = "题干内标注"
INLINE_CHOICE_SOURCE = "题干末尾标注"
PAPER_ANSWER_SOURCE = "原卷题后参考答案"
NUMBER_MATCH_SOURCE = "原卷明确答案 · 题号二次校验"
ORDER_MATCH_SOURCE = "原卷答案顺序 · 一一对应校验"
URL_LINE = r"(?i)https?://"
BARE_NUMBER_LINE = r"^[0-9]{1,4}\z"
PAGE_HEADER_LINE = rf"页码[，,]{WS}*[0-9]+{WS}*/{WS}*[0-9]+"
CHAPTER_LINE = rf"^第[一二三四五六七八九十百0-9]+章{WS}*(.+?)(?:{WS}+答案)?\z"
ANSWER_HEADING_LINE = rf"^(.{{1,40}}?){WS}+答案\z"
SECTION_LINES = [
    ("single", rf"^[一二三四五六七八九十]+[、.．]{WS}*(?:单项|单选)"),
    ("multiple", rf"^[一二三四五六七八九十]+[、.．]{WS}*(?:多项|多选)"),
    ("judgement", rf"^[一二三四五六七八九十]+[、.．]{WS}*判断|^判断题{WS}*[:：]?\z"),
    ("skip", rf"^[一二三四五六七八九十]+[、.．]{WS}*(?:填空|名词解释|问答|简答|病例分析)"),
]
ANSWER_LETTERS = f"[A-Ga-gＡ-Ｇａ-ｇ、，,{_SPACE_CLASS}]+"
EXPLICIT_ANSWER = rf"(?:正确)?答案{WS}*[:：]{WS}*({ANSWER_LETTERS})"
ANSWER_SPLIT = rf"答案{WS}*[:：]"
EXAM_HEADER = rf"(?i)((?:19|20)[0-9]{{2}}){WS}*N{WS}*([0-9]{{1,3}}){WS}*([ABCX]){WS}*[.．、]{WS}*"

# Exam blueprint: (question type, first number, last number, points).
PROFILE = "western-medicine-306"
MODERN, LEGACY, UNKNOWN = "modern-165", "legacy-c-type", "unknown-306"
PROFILE_PATTERN = (rf"(?i)(?:西医综合|西综|临床医学综合能力{WS}*[（(]?西医[）)]?"
                   r"|(?:^|[^0-9])306(?:[^0-9]|\z))")
MODERN_SECTIONS = [("A", 1, 40, 1.5), ("A", 41, 115, 2.0), ("B", 116, 135, 1.5), ("X", 136, 165, 2.0)]
LEGACY_1994_SECTIONS = [("A", 1, 92), ("B", 93, 118), ("C", 119, 138), ("X", 139, 160)]
MODERN_TOTAL, MODERN_FROM_YEAR = 300, 2017

# Group suggestion, first match wins.
GROUP_RULES = [
    ("考研西综306", PROFILE_PATTERN),
    ("儿科学", r"(?i)儿科|新生儿|小儿"),
    ("妇产科学", r"(?i)妇产|产科|妇科|妊娠|分娩"),
    ("耳鼻咽喉科学", r"(?i)耳鼻咽喉|耳科|鼻科|咽喉"),
    ("医学影像学", r"(?i)影像|放射|CT|MRI|超声"),
    ("全科医学", r"(?i)全科|社区医学|家庭医学"),
]
UNGROUPED = "未分组题库"
DEFAULT_BANK_NAME = "未命名题库"

# Discussion.
BLOCKED_TERMS = ["代考", "卖答案", "裸聊", "博彩", "赌博", "办证", "刷单", "引流", "加微信"]
BLOCKED_REASON = "命中待审核词："
REPORT_REASON = "收到 3 次以上举报"
REPORT_THRESHOLD = 3
COMMENT_MIN, COMMENT_MAX, QUESTION_ID_MAX = 2, 300, 120
HIDDEN_TEXT = "[已隐藏]"

# Limits.
LEGACY_TIMESTAMP = 1
LEDGER_ID_MAX = 240
QUESTION_CAP, BUNDLE_ID_MAX = 25_000, 160
DAILY_LIMIT = 20
STATE_KEYS = ["progress", "firstProgress", "favorites", "notes", "recordLedger", "settings",
              "nickname", "bankName", "questionBanks", "englishTests", "englishPractice"]

# Search scores: (whole field, prefix, contained).
SEARCH_BONUS = {"bank": 180, "group": 120, "stem": 90, "category": 70}

# English papers.
STAGES = ["cet", "postgraduate", "ielts", "toefl"]
ENGLISH_KINDS = ["cloze", "word-bank", "reading", "matching", "long-reading", "listening",
                 "writing", "translation"]
COMPANION_NAME = r"(?i)答案|解析|详解|answer|analysis|solution|explanation|key"
NO_MEANING = "待使用自定义 AI 补全释义"

# Question anchors in exam papers, answers beside them, compact answer tables.
ANCHOR = rf"(?:^|\n){WS}*(?:(?:19|20)[0-9]{{2}}{WS}*N{WS}*)?([0-9]{{1,3}}){WS}*(?:[ABCX]{WS}*)?[.．、]"
BLOCK_ANSWER = rf"(?i)(?:【|\[)?{WS}*(?:参考)?答案{WS}*(?:】|\])?{WS}*[:：]?{WS}*([A-G]{{1,7}})(?![A-Za-z])"
COMPACT_ANSWER = rf"(?i)(?:^|[,，;；{_SPACE_CLASS}])([0-9]{{1,3}}){WS}*[.、:：\-]?{WS}*([A-G]{{1,7}})(?=\z|[,，;；{_SPACE_CLASS}])"
ANSWER_HINT = r"(?i)(?:参考)?答案|答案表|正确答案|解析"
OPTION_LINE = rf"(?:^|\n){WS}*[A-G]{WS}*[.．、]"
PAGE_MARK = rf"(?i)\[\[PAGE{WS}+[0-9]+\]\]"
CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_BOUNDARY = 24_000, 1_000, 0.65
PACK_CHARS, PACK_MIN, PACK_MAX, PACK_QUESTIONS, PACK_ANCHORS, PACK_FALLBACK = 7_200, 4_800, 8_000, 14, 8, 3_600
SEAM_HEAD = 3_600

# English papers: headings, markers and answer notes.
_W = WS
STAGE_RULES = [("ielts", "ielts|雅思"), ("toefl", "toefl|托福"),
               ("postgraduate", "考研|硕士研究生|研究生招生|postgraduate|graduate entrance|national entrance")]
CET6, CET4 = rf"(?i)CET{_W}*[- ]?6|六级", rf"(?i)CET{_W}*[- ]?4|四级"
POSTGRADUATE_I = rf"(?i)英语{_W}*[（(]?一[）)]?|English{_W}+I"
POSTGRADUATE = "(?i)考研|硕士研究生|研究生招生"
VARIANTS = ("CET-6", "CET-4", "Postgraduate English I")
KIND_RULES = [("writing", "writing|essay|作文|写作"), ("translation", "translation|translate|翻译"), ("listening", "listening|听力"),
              ("cloze", "cloze|use of english|完形"), ("matching", rf"part{_W}*b|41{_W}*[-–]{_W}*45|paragraph matching|段落匹配")]
TASK_WORDS = (r"writing|listening(?: comprehension)?|reading(?: comprehension)?|cloze(?: test)?|use of english|translation"
              "|写作|听力|阅读|完形填空|翻译")
LINE_START = r"(?:^|\n)"
EN_HEADING = rf"(?i){LINE_START}{_W}*((?:Section{_W}+[IVX]+{_W}*)?(?:{TASK_WORDS})[^\n]*)"
EN_PART = rf"(?i){LINE_START}{_W}*Part{_W}+([A-D]){_W}*(?=\n|\z)"
EN_TEXT = rf"(?i){LINE_START}{_W}*Text{_W}+([1-4]){_W}*(?=\n|\z)"
EN_HAS_PARTS = rf"(?i)Part{_W}+[AB]"
EN_QUESTION = rf"{LINE_START}{_W}*([1-9][0-9]{{0,2}}){_W}*[.)、]{_W}*"
EN_QUESTION_SPACED = rf"{LINE_START}{_W}*[1-9][0-9]{{0,2}}{_W}*[.)、]{_W}+"
EN_OPTION = rf"[【\[]{_W}*([A-G]){_W}*[】\]]{_W}*|(?:^|\n|{_W}{{2,}})([A-G]){_W}*[.)、:] ?{_W}*"
EN_FIRST_OPTION = rf"[【\[]{_W}*A{_W}*[】\]]"
EN_CLOZE_ROW = rf"{LINE_START}{_W}*([1-9]|1[0-9]|20){_W}+(?={EN_FIRST_OPTION})"
EN_TRANSLATION = rf"\((4[6-9]|50)\){_W}*"
EN_KEY = rf"(?i){LINE_START}{_W}*([1-9][0-9]{{0,2}}){_W}*[.、]?[ \t]*[【\[]{_W}*(?:答案|answer){_W}*[】\]][ \t]*([A-G])(?![A-Za-z0-9_])"
EN_KEY_ONE = EN_KEY.replace("([1-9][0-9]{0,2})", "1")
EN_KEY_NOTE = rf"(?i)[【\[]{_W}*(?:解析|详解|analysis|explanation){_W}*[】\]]{_W}*([\s\S]*)"
EN_KEY_HEADING = rf"(?i){LINE_START}{_W}*(?:answers?|answer key|参考答案|答案){_W}*[:：]?"
EN_KEY_LIST = rf"(?:^|[,，;；{_SPACE_CLASS}])([1-9][0-9]{{0,2}}){_W}*[.)、:：-]?{_W}*([A-G])(?=\z|[,，;；{_SPACE_CLASS}])"
EN_NOTES_START = r"(?:真题解析|答案解析|(?i:answer explanations))"
CET_PAPER = rf"(?i)CET{_W}*[- ]?6|六级|Part{_W}+III{_W}+Reading{_W}+Comprehension"
CET_PART = (rf"(?i){LINE_START}{_W}*Part{_W}+([IVX]+)[^A-Za-z\n]{{0,12}}"
            rf"(Writing|Listening{_W}+Comprehension|Reading{_W}+Comprehension|Translation)(?![A-Za-z0-9_])")
CET_SECTION = rf"(?i){LINE_START}{_W}*Section[^A-Za-z\n]{{0,10}}([ABC](?![A-Za-z0-9_]))?[^\n]*"
CET_TALK = rf"(?i){LINE_START}{_W}*(?:Conversation|Passage|Recording){_W}+(?:One|Two|Three|1|2|3)(?![A-Za-z0-9_])"
CET_PASSAGE = rf"(?i){LINE_START}{_W}*Passage{_W}+(?:One|Two|1|2)(?![A-Za-z0-9_])"
CET_WORD_KEY = rf"{LINE_START}{_W}*(2[6-9]|3[0-5]){_W}*[.、]{_W}*([A-O]){_W}*[).]{_W}*([A-Za-z][A-Za-z'\-]*)"
CET_BLOCK = rf"{LINE_START}{_W}*([1-9]|[1-4][0-9]|5[0-5]){_W}*[.、]{_W}*"
CET_BLOCK_KEY = rf"(?i)(?:正确答案(?:为|是)?|故选) ?{_W}*([A-O])(?![A-Za-z0-9_])|([A-O])项(?:正确|符合)"
CET_BLOCK_KEY_2 = rf"(?i)(?:答案解析|答案) ?{_W}*([A-O]){_W}*[.。]"
CET_FIRST_WORD_KEY = rf"{LINE_START}{_W}*26{_W}*[.、]{_W}*[A-O]{_W}*[).]"
# Openings of the translation task, used only where its part heading is unreadable.
CET_TRANSLATION_TOPIC = rf"(?i)(?:cubic{_W}+meter|The{_W}+Tiangong{_W}+Space{_W}+Station)"
CET_TRANSLATION_CUE = rf"(?i)(?:Part{_W}+IV[^A-Za-z\n]{{0,12}}Translation|cubic{_W}+meter|The{_W}+Tiangong{_W}+Space{_W}+Station)"
CET_NOTE = r"(?i)(?:解析|答案解析|analysis)"
CET_DETAIL = rf"(?i)(?:答案详解|答案解析|26{_W}*[.、]{_W}*[A-O]{_W}*[).])"
CET_LONG_DETAIL = rf"(?i)(?:答案详解|答案解析){_W}*[:：]?"
CET_WORD = rf"(?:^|{_W})([A-O]){_W}*[).]{_W}*([A-Za-z][A-Za-z'\-]*)"
CET_PARAGRAPH = rf"{LINE_START}{_W}*([A-O]){_W}*[).] ?{_W}*"
CET_STATEMENT = rf"{LINE_START}{_W}*(3[6-9]|4[0-5]){_W}*[.、]{_W}*"
CET_REFERENCE = "(?i)参考译文|reference translation"
DIRECTIONS_TO_SHEET = (rf"(?i)\A{_W}*Directions?{_W}*:{_W}*[\s\S]{{0,3000}}?ANSWER{_W}+SHEET(?:{_W}+[0-9]+)?[.!]?{_W}*"
                       rf"(?:\([^)]*\))?{_W}*")
DIRECTIONS = rf"(?i)\A{_W}*Directions?{_W}*:{_W}*"
INSTRUCTION = (rf"(?i)\A{_W}*(?:(?:Read|Choose|Answer|Mark|Translate|Write|Complete|Fill|Match)(?![A-Za-z0-9_])"
               rf"|For{_W}+Questions?(?![A-Za-z0-9_])|In{_W}+this{_W}+(?:section|part)(?![A-Za-z0-9_])"
               rf"|You{_W}+(?:are|should|must|will)(?![A-Za-z0-9_])|Paragraphs?{_W}+[A-G](?![A-Za-z0-9_]))"
               rf"[^.!?\n]*(?:[.!?]{_W}*|\n+|\z)")
POINTS_NOTE = rf"(?i)\A{_W}*\({_W}*[0-9]+{_W}+points?{_W}*\){_W}*"
