"""Vocabulary patterns and their translation to Spark's (Java) and DuckDB's (RE2) regular expressions.

Patterns are kept once, in a neutral notation: ``\\b`` is an ASCII word boundary, ``\\s`` any Unicode white space and
``$`` the very end of the text. ``(?i)`` in front makes a pattern ignore case.
"""

from __future__ import annotations

import re

#: White space of the neutral notation, for use inside a class.
SPACE = r"\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _translate(pattern: str, boundary: str, flags: str) -> str:
    ignore = pattern.startswith("(?i)")
    body, out, inside, k = pattern.removeprefix("(?i)"), [], False, 0
    while k < len(body):
        two = body[k : k + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            k += 2
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
            k += 2
        elif two == r"\b" and not inside:
            out.append(boundary)
            k += 2
        elif body[k] == "\\":
            out.append(two)
            k += 2
        else:
            if body[k] == "[":
                inside = True
            elif body[k] == "]":
                inside = False
            out.append(r"\z" if body[k] == "$" and not inside else body[k])
            k += 1
    return (flags if ignore else "") + "".join(out)


def java(pattern: str) -> str:
    """The pattern for Spark's rlike and regexp functions."""
    return _translate(pattern, _EDGE, "(?iu)")


def re2(pattern: str) -> str:
    """The pattern for DuckDB; lookaround is not available there."""
    return _translate(pattern, r"\b", "(?i)")


def any_of(patterns: list[str] | tuple[str, ...], to=java) -> str:
    """One alternation of several patterns, each with its own case rule."""
    parts = []
    for p in patterns:
        t = to(p)
        flag = re.match(r"\(\?iu?\)", t)
        parts.append(f"(?{flag[0][2:-1]}:{t[flag.end() :]})" if flag else f"(?:{t})")
    return "|".join(parts)


# The vocabulary that decides what may become a memory and of which type. The order of the families, and
# of the patterns in each, is part of the semantics.
TYPE_SIGNALS = (
    ("constraint", 1.0, (r"必须", r"务必", r"一定要", r"千万", r"不能", r"不要", r"别去", r"别[乱去用动改加再拆写]", r"不准", r"禁止", r"只能", r"统一用", r"约定", r"规范是", r"(?i)\bmust\b", r"(?i)\bnever\b", r"(?i)\balways\b", r"(?i)\bdo not\b", r"(?i)\bdon't\b", r"(?i)\brequired\b", r"(?i)\bforbidden\b", r"(?i)\bmandatory\b")),
    ("pitfall", 0.95, (r"踩(过|了)?坑", r"坑(是|在于|点)", r"会(报|抛|出)错", r"会失败", r"会挂", r"会导致", r"记得(避开|绕开)", r"注意(别|不要)", r"小心", r"上次.*(问题|失败|崩)", r"曾经.*(失败|崩)", r"(?i)\bpitfall\b", r"(?i)\bgotcha\b", r"(?i)\bbreaks?\b", r"(?i)\bcrashe?s?\b", r"(?i)\bfails?\b", r"(?i)\bwatch out\b", r"(?i)\bcaveat\b")),
    ("rejected", 0.9, (r"不用", r"不考虑", r"否决", r"排除", r"放弃", r"别用", r"(?i)\bruled out\b", r"(?i)\brejected\b", r"(?i)\bnot going to use\b")),
    ("decision", 0.85, (r"决定", r"确定(用|了)", r"选择", r"改(成|为)了?", r"换成", r"采用", r"方案(是|定)", r"最终(用|选)", r"(?i)\bdecided\b", r"(?i)\bwe chose\b", r"(?i)\bgoing with\b", r"(?i)\binstead of\b", r"(?i)\bsettled on\b")),
    ("procedure", 0.8, (r"流程", r"步骤", r"发布前", r"上线前", r"先.+再.+然后", r"(?i)\brunbook\b", r"(?i)\bchecklist\b", r"(?i)\bstep \d")),
    ("preference", 0.7, (r"我喜欢", r"偏好", r"习惯", r"以后都", r"默认(用|走)", r"(?i)\bi prefer\b", r"(?i)\bi like\b", r"(?i)\bby default\b")),
)
EMPHASIS = (
    (0.2, (r"记住", r"记一下", r"请牢记", r"(?i)\bremember\b", r"(?i)\bnote that\b", r"(?i)\bkeep in mind\b")),
    (0.15, (r"以后", r"下次", r"今后", r"从现在起", r"(?i)\bfrom now on\b", r"(?i)\bnext time\b")),
    (0.12, (r"`[^`]+`",)),
    (0.08, (r"(?i)\bpnpm\b|\bnpm\b|\bgit\b|\.ya?ml\b|\.json\b|\/[a-z_-]+\/",)),
)
NOISE = (
    r"(?i)^(好|好的|好呀|行|可以|嗯|哦|噢|知道了|收到|谢谢|多谢|辛苦了|没问题|继续|开始吧|来吧|ok|okay|yes|yep|no|sure|thanks|thank you|got it|cool|nice|go ahead|continue)[\s。.!！~～]*$",
    r"^(嗯+|哦+|啊+|哈+|额+)[。.!！~～]*$",
    r"^(请)?(继续|接着|往下)(吧|做|写|改)?[。.!！~～]*$",
)
TASK_INSTRUCTIONS = (
    r"按(下面|以下|上述|这个|此)(的)?(步骤|要求|说明|格式|模板)",
    r"不要做(任何)?(额外|多余)的?(事|工作|动作)",
    r"第\s*\d+\s*步",
    r"(?i)(调用|使用)\s*`?\w+`?\s*(工具|tool)",
    r"把.{2,40}(贴|输出|打印|报告|回复|告诉)(出来|给我)",
    r"回复(一行|不超过|以下格式|我)",
    r"(严格)?按(这个|此|上述)?(格式|模板|要求)(回复|输出|返回)",
    r"不要(改写|总结|解释|评价|自己组织)",
    r"^(请)?(先|再|直接)?(你)?(帮我|帮忙)(做|写|看|检查|改)",
    r"^(先|再|然后|接着)?(看|查|检查|确认|列出|读)(一下|看)?[^。]{0,24}(是否|有没有|有哪些)",
    r"(你|请|麻烦|劳驾)(先|再|直接)?(来)?(说说|说一下|讲一下|讲讲|解释一下|说明一下|描述一下|总结一下|列一下|列出来)",
    r"^(你|请|麻烦)?(先|再|直接)?(说|讲|解释|说明|总结|描述|列出|回答|回复)(一下|一遍)",
    r"^(告诉|回复|回答|给我|帮我|请你|麻烦你|我要你)",
    r"(说一下|说说|讲一下|解释一下|总结一下|列一下)(怎么|如何|为什么|什么|你|我)",
)
REMEMBER_REQUESTS = (r"记住", r"记一下", r"记下", r"记录下来?", r"记录一下", r"别忘了", r"(?i)\bremember\b", r"(?i)\bnote that\b", r"(?i)\bkeep in mind\b")
PAYLOADS = (r'\{"[^"]+"\s*:', r"^\s*[\[{]", r"```")
SECRETS = (
    r"(?i)\bapikey_[A-Za-z0-9_]{16,}",
    r"(?i)\b(?:sk|pk|rk|ts|api)[_-][A-Za-z0-9_-]{20,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.",
    r"(?i)\b(?:api[_-]?key|access[_-]?token|secret|password|passwd|bearer)\b\s*[:=]?\s*\S{12,}",
    r"(?i)\b[0-9a-f]{48,}\b",
)
TRANSCRIPTS = (r"(?i)^(?:你|我|他|她|面试官|面试者|面试人|候选人|提问者|回答者|用户|助手|ai|assistant|user|human|interviewer|candidate)\s*[:：]",)
FRAGMENTS = (
    r"^\s*(?:\/\/|\/\*|\*\/|#!)",
    r"^\s*(?:if|else|for|while|switch|return|const|let|var|function|class|public|private|protected|package|import|export|void|int|string|def|func|struct|impl)\b",
    r";\s*$",
    r"^\s*(?:\*\*|---+|#{1,6}\s|\|\s)",
)
QUESTION_MARKERS = r"哪些|啥|能不能|可不可以|是什么|怎么|为什么|如何|吗|呢|多少|是不是|有没有"
INSTRUCTION_MARKERS = r"不要|不准|别|必须|应当|应该|请|改|加|删|禁止|务必"
#: A decision, not followed by a question particle: kept as (pattern, particles) so that it can be said without lookahead.
DECISION_ASSERTIONS = (r"我(?:再次|再)?申明", r"我(?:觉得|认为|要求|决定|希望)不", r"不需要吧", r"不用吧")
DECISION_STATED = (r"我们?决定", r"^(?:了?吗|呢)")
INTERROGATIVES = (
    r"[?？]$",
    r"(是什么|在哪里|在哪|怎么用|怎么回事)[？?]?$",
    r"有哪些[^。！？!?]{0,8}[？?]?$",
    r"[吗嗎呢]$",
    r"难道|岂不|是不是|要不要|有没有",
    r"(?i)^(什么|怎么|如何|为什么|哪|谁|何时|多少|是否|能不能|可不可以|有没有|why|what|how|which|who|when|where|is |are |can |could |should |do |does |did )",
)
#: Ordered folds of a signature: what differs only in these is the same.
SIGNATURE_FOLDS = (
    (r"`[^`]*`", "<code>"),
    (r"'(?:[^'\\]|\\.)*'", "<str>"),
    (r'"(?:[^"\\]|\\.)*"', "<str>"),
    (r"\b[\w./-]*\/(?:[\w.-]+\/?)+", "<path>"),
    (r"(?i)\b[0-9a-f]{7,}\b", "<hex>"),
    (r"\d+", "<n>"),
)
NAME_LIKE = r"\b[A-Za-z][A-Za-z0-9_.-]{4,}\b"
NOTEWORTHY_VETOES = ("secret", "task-instruction", "payload", "fragment", "transcript")
BARE_ERRORS = r"(?i)^(?:未知错误|unknown(?: error)?|error|failed|failure)$"
BARE_CODE = r"^[A-Z][A-Z0-9_]{2,}$"
#: Characters that the echo comparison ignores, besides white space.
ECHO_IGNORED = ".,;:!?，。；：！？、\"'“”‘’（）()[]{}<>《》—–-"
MEMORY_TYPES = ("constraint", "pitfall", "decision", "preference", "procedure", "rejected", "fact")
#: Canonical rewrites: wrapping quotes, labels and refusals of a model.
OPENING_QUOTES = r"^[\"'“”「『]+"
CLOSING_QUOTES = r"[\"'“”」』]+$"
ANSWER_LABELS = r"^(整理后|整理|结果|输出)[:：]\s*"
REFUSALS = r"(?i)^(抱歉|对不起|无法|不能|sorry|cannot|i can)"
#: Scratch files of pastes, which are gone later: temporary folders and names like <tool>-paste-<id>.
SCRATCH_PATHS = r"\/private\/var\/folders\/\S+|\/var\/folders\/\S+|\/tmp\/\S+|[a-z]+(?:-[a-z]+)*-paste-\S+"
FOLD_MARKER = r"<(?:code|str|path|hex|n)>"
STATUSES = ("active", "needs-review", "superseded")
