"""The word lists and character classes of Chinese meeting language."""

CJK = "一-鿿㐀-䶿豈-﫿"
SENTENCE_END = "。！？!?.；;…"
CLOSERS = "”）\"'"
CJK_PUNCTUATION = "。，、；：？！“”‘’（）《》〈〉「」『』【】〔〕—…～·　％＃＆￥"
FULL_WIDTH = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = " " + "".join(map(chr, range(0x21, 0x7F)))

DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10**4, "亿": 10**8}
DATE_UNITS = "月日号年时分秒周季天"
LARGEST = 9_999_999_999_999

#: In order: the first trigger that a sentence holds gives its kind.
DECISIONS = (
    ("否决", ("不同意", "不通过", "否决", "驳回", "否决掉", "暂缓", "取消")),
    ("通过", ("通过", "批准", "审批通过")),
    ("确定", ("决定", "确定", "敲定", "定下来", "拍板", "就按", "就这么定")),
    ("同意", ("同意", "赞成", "认可", "无异议", "没意见", "达成一致", "达成共识", "一致同意")),
)
ENQUIRIES = ("能不能", "是否通过", "会不会")
DENIALS = ("不同意", "不赞成", "无法同意")
ACTION_TRIGGERS = (
    "待办", "行动项", "行动计划", "跟进", "负责", "责任人", "务必", "请", "需要", "尽快",
    "落实", "安排", "提交", "输出", "整理", "补充", "对接", "推动",
    "修复", "优化", "准备", "调研", "确认", "明确", "制定", "完成", "推进",
    "同步", "核销", "锁定", "敲定", "抓一下", "盯一下", "排一下", "拉个",
)
FILLERS = ("那个", "然后", "其实", "我觉得", "我认为", "那么", "所以", "另外", "另外呢", "嗯", "呃", "就是", "就是说", "我们")
HIGH = ("尽快", "紧急", "优先", "必须", "立刻", "马上", "今天", "今日", "明天", "立即", "加急", "最高")
LOW = ("可以", "可选", "有空", "不急", "不急吧", "有时间", "顺带", "顺便")

OWNER_MARKERS = ("负责", "跟进", "落实", "推动", "主责", "牵头", "对接", "盯一下", "抓一下", "担纲", "承办")
OWNER_LEADS = ("由", "请", "让", "叫")
OWNER_TAILS = "来去再先"
NOT_IN_NAMES = "在于的要需请把给和与并且就能会负跟落推主牵对完准提整排确同告做去来再先尽下上本该等或是有没不很这那由让叫"
NOT_FIRST_IN_NAMES = (
    "继尽抓统及优认积共按随直赶先再又也还就才只更最很太不没别务必应该能会想要需请把给和与并且从向对为以于在的地得了着过自各全多少好"
    "落推翻排完提整确做去来下上本等或是有同针关由被替跟"
)
NOT_NAMES = frozenset(
    "我们 你们 他们 大家 各位 团队 小组 部门 公司 这个 那个 本次 这次 下次 后续 相关 有关 主要 重点 整体 统一 专人 "
    "自己 本人 对方 双方 甲方 乙方 产品 研发 测试 运营 设计 前端 后端 算法 项目 会议 议题 方案 需求 问题 工作 任务 "
    "什么 谁 哪个 由谁 需要 必须 可以 应该 是否 怎么 "
    "日前 之前 之后 以后 以前 现在 目前 当时 会上 会后 当天 到时 届时 近期 近期内 下周 本周 这周 上周 月底 "
    "季度末 周内 年内 明天 后天 今天 今日 明日 下个月 这个月 "
    "尽快 具体 抓紧 统一来 先把 先由 然后 接着 直接 马上".split()
)

RELATIVE_DAYS = (("今天", 0), ("今日", 0), ("明天", 1), ("明日", 1), ("后天", 2), ("大后天", 3))
CLOSING = ("就到这里", "就到这儿", "就结束", "就散会", "先这样", "先到这", "到此为止", "再聊", "再说吧", "下次再说", "今天就到这")
WEEK_PREFIXES = (("下下周", 2), ("下周", 1), ("本周", 0), ("这周", 0), ("周", 0))
WEEKDAYS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "日": 7, "天": 7}

QUESTION_ENDS = (
    "吗", "呢", "么", "是不是", "有没有", "行不行", "好不好", "对不对", "如何", "是否", "为什么", "怎么", "怎样", "多少",
    "哪些", "哪个", "哪里", "什么时候", "能不能", "可不可以", "要不要", "值不值",
)
QUESTION_INNER = ("为什么", "怎么", "是否", "能不能", "要不要", "多少")
IMPERATIVE_STARTS = ("请", "麻烦", "务必", "尽快", "记得", "别忘", "一定要", "需要你", "麻烦你")
BREAK_ANCHORS = (
    "但是", "不过", "然而", "所以", "因此", "然后", "接着", "另外", "此外", "同时", "因为", "由于", "而且", "并且",
    "其实", "另外一方面", "另一方面", "第一", "第二", "第三", "第四",
)
TERMINAL = SENTENCE_END + "，、：”）"

BLANK_SPEECH = ("blankaudio", "silence", "inaudible", "nospeech")
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{a}{i}" for a in ("COM", "LPT") for i in range(1, 10)))
