"""Problem 5: personal data inside free text, found by anchors and expanded by local parsers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import map_batches, pick, text_column
from .lookalike import _FOREIGN, _HIDDEN, _PLAIN, _WORD, _one_alphabet, _ordinary

KINDS = ("email", "phone", "id_number", "address", "name")
#: Bank cards and account numbers are masked as well; they are a kind of their own.
ACCOUNT = "account"

# Anchors, by what they may announce; all are looked for in one pass over the lower-cased text.
ANCHORS = {
    "at": ("@", " at ", "[at]", "(at)", "{at}", "<at>", " (at) ", "艾特", "#at#"),
    "link": ("http://", "https://", "ftp://", "www."),
    "digit": tuple("0123456789"),
    "spoken": tuple("零〇一二三四五六七八九幺"),
    "zh": ("号",),
    "en": ("street", "road", "lane", "avenue", "row", "drive", "boulevard", "way", "court", "place", "square", "terrace", "crescent", "close"),
    "fr": ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "route"),
    "ru": ("ул.", "улица", "улице", "проспект", "пр-т", "переулок", "пер.", "шоссе", "бульвар", "набережная"),
    "id_cue": (
        "身份证", "证件", "护照", "实名", "申报", "清关", "报关", "海关", "通行证", "户口", "驾照", "驾驶证", "社保", "认证", "核验", "登记", "填写", "填的", "填错", "passport", "id", "identity", "ssn", "social security", "national insurance", "customs", "licence", "license",
        "form", "document", "passeport", "carte d'identité", "carte d’identité", "sécurité sociale", "паспорт", "снилс", "инн", "удостоверени",
    ),
    "phone_cue": ("电话", "手机", "号码", "微信", "拨", "打", "联系", "致电", "来电", "call", "text", "phone", "line", "tel", "reach", "mobile", "whatsapp", "cell", "dial", "at", "or", "tél", "téléphone", "appel", "portable", "joindre", "тел", "телефон", "звон", "номер"),
    "account_cue": ("卡号", "银行卡", "信用卡", "储蓄卡", "账号", "帐号", "账户", "card", "account", "iban", "bank", "carte bancaire", "compte", "карт", "счет", "счёт"),
    "not_zh": ("订单", "单号", "运单", "快递单", "批次", "编号", "券码", "券号", "优惠码", "兑换码", "序列号", "设备", "条码", "货号", "型号", "款号", "流水", "卡券"),
    "not_en": ("order", "parcel", "tracking", "batch", "serial", "coupon", "voucher", "code", "imei", "s/n", "model", "sku", "invoice", "device", "ticket", "lot", "commande", "colis", "facture", "заказ", "заказа", "посылк", "трек"),
    # Words for the person who is named: an identity, a part played, a relation; and what is done to or by a person.
    "name": ("收件人", "收货人", "寄件人", "签收人", "取件人", "联系人", "持卡人", "姓名", "名字", "全名", "真名", "本人", "我叫", "名叫", "叫做", "落款", "署名", "签名", "户名", "抬头"),
    "person": tuple(
        "经办人 负责人 投保人 监护人 我是 店主 店长 店员 老板娘 老板 掌柜 卖家 买家 客服 导购 销售 经理 主管 快递员 快递 小哥 派件员 配送员 送货员 骑手 司机 师傅 技师 工程师 安装工 维修工 物业 门卫 保安 邻居 室友 同事 同学 同桌 朋友 闺蜜 网友 老公 老婆 媳妇 丈夫 妻子 爱人 对象 "
        "男友 女友 男朋友 女朋友 爸爸 妈妈 父亲 母亲 哥哥 姐姐 弟弟 妹妹 大哥 大姐 儿子 女儿 孩子 表哥 表姐 表弟 表妹 堂哥 堂姐 叔叔 阿姨 舅舅 姑姑 侄子 侄女 外甥 爷爷 奶奶 外公 外婆 姥姥 姥爷 岳父 岳母 婆婆 公公 老师 医生 大夫 护士 律师 教练 主播 博主 作者 班长 队长 组长 院长 校长 "
        "主任 秘书 会计 房东 租客 户主 机主 车主 业主 感谢 谢谢 多谢 辛苦 麻烦 找 联系 叫 由 发给 寄给 转给 交给 送给 留给 写给 写着 写的是 认识 遇到 遇见 碰到 碰见".split()
    ),
    "maybe": ("的", "是", "给", "和", "跟", "与", "让", "请", "问", "替", "被"),
    "after": ("女士", "先生", "小姐", "太太", "老师", "代签", "代收", "签收"),
    "name_en": (
        "send it to", "send to", "ship to", "ship it to", "reach", "signed for by", "signed by", "ask for", "thanks to", "my name is", "name is", "contact", "deliver to", "delivered to", "care of", "attention of", "regards,", "call", "this is", "met", "dear", "addressed to", "spoke to", "spoke with",
    ),
    # After these only words that begin with capitals are taken for a name, and none in a text where every word does.
    "title_en": (
        "by", "from", "with", "named", "called", "i am", "i'm", "husband", "wife", "son", "daughter", "father", "mother", "brother", "sister", "friend", "neighbour", "neighbor", "colleague", "boss", "manager", "driver", "courier", "agent", "technician", "seller", "owner", "teacher", "doctor", "sincerely,", "cheers,", "best,", "yours,", "thank you,", "thanks,", "ask", "met",
    ),
    "title_fr": (
        "m'appelle", "m’appelle", "je suis", "mon nom est", "signé", "signé par", "par", "merci à", "contactez", "contacter", "demandez", "livré à", "livrer à", "envoyez à", "adressé à", "l'attention de", "l’attention de", "destinataire", "cordialement,", "mari", "femme", "voisin", "voisine", "ami", "amie", "livreur", "vendeur", "vendeuse", "collègue",
    ),
    "title_ru": (
        "зовут", "получатель", "отправитель", "спасибо", "благодарю", "курьер", "курьеру", "продавец", "менеджер", "оператор", "муж", "жена", "сосед", "соседка", "подруга", "друг", "имя", "подпись", "уважением,", "обращайтесь к", "мастер", "коллега", "фио",
    ),
    "titled": ("mr", "mrs", "ms", "dr", "miss", "monsieur", "madame", "mme", "mlle", "господин", "госпожа"),
}
#: Anchors of letters stand as words of their own; these may go on, as they are stems.
STEMS = frozenset(("appel", "телефон", "звон", "тел", "удостоверени", "карт", "счет", "счёт", "посылк", "трек", "паспорт", "номер", "text", "call", "phone", "mobile", "order", "coupon", "ticket", "model", "code", "licence", "license", "document"))

# Common family names, the most frequent first.
FAMILY = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓韩冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾"
    "夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤康易乔赖文樊兰殷施洪翟安颜倪牛温芦季俞章鲁葛伍申尤毕聂"
    "柴焦柳邢岳齐梅庄辛管祝左涂谷祁时舒耿牟卜路詹关苗凌费纪靳盛童欧甄项曲成游阳阮蔺郁闻喻裴宁简岑"
)
COMPOUND = "欧阳|司马|上官|诸葛|司徒|东方|独孤|南宫|夏侯|皇甫|尉迟|公孙|慕容|令狐|宇文|长孙|端木|百里"
#: Characters that don't stand in a given name.
NOT_GIVEN = "的了是在我你他她它们不也就都还很太个这那什么没有和与及或被把让给说吗呢吧啊呀哦收到货买家店客服件价格质量包装物流点帮打送签代换退修装拆洗问写寄些次款块元只却但因所其此该每各另您咱谁哪怎且则"
# Common words that begin like a name.
WORDS_LIKE_NAMES = frozenset(
    "白色 白天 白送 白买 黄色 黄金 黄瓜 金色 金属 金额 高兴 高档 高端 高度 高级 高温 高低 高清 高效 高压 方便 方式 方法 方面 方向 方案 方形 安装 安全 安静 安心 安排 温度 温和 温馨 温暖 温柔 温水 温润 温热 程度 程序 时间 时候 时尚 时常 时而 于是 马上 马桶 马虎 万一 万能 万分 常常 常用 常见 "
    "常温 成功 成本 成分 成品 平时 石头 石材 毛病 毛巾 毛边 毛衣 毛刺 毛躁 牛奶 牛皮 牛肉 关于 关系 关键 关闭 关心 关注 简单 简直 简约 简陋 简易 夏天 夏季 江南 何况 何必 何时 何处 易碎 易用 易坏 易洗 路上 路由 路过 路程 梅雨 叶子 李子 张开 张嘴 张贴 陈旧 陈列 胡乱 胡说 许多 许久 谢谢 谢意 孔位 "
    "孔径 游戏 游泳 项目 项链 顾客 顾虑 宁可 宁愿 宁静 舒服 舒适 舒心 段时 段落 雷同 雷人 龙头 武器 戴着 戴上 严重 严格 严实 严谨 向上 向下 向来 向着 康复 贺卡 汤圆 管理 管子 管用 管道 祝福 祝愿 左右 左边 左侧 费用 费劲 费水 费电 费时 盛开 童装 童年 曲线 阳光 阳台 闻到 闻着 闻起 范围 "
    "付款 付钱 付费 钱包 季节 季度 章程 施工 洪水 兰花 殷勤 凌晨 凌乱 苗条 齐全 齐整 庄重 辛苦 辛辣 涂层 涂抹 谷物 任何 任务 任意 余额 余下 余量 史上 文字 文件 文案 文明 文化 文具 申请 申诉 申报 尤其 焦虑 焦味 欧式 欧洲 甄选 钟头 钟点 田园 林子 汪汪 丁点 马达 唐装 宋体 韩式 韩国 苏州 杜绝 崔促 石英 孟买 秦岭 常年 温差".split()
)

_HAN = regex.compile(r"\p{Han}")
_GIVEN = rf"[\p{{Han}}--[{NOT_GIVEN}]]"
_FULL_NAME = rf"(?:(?:{COMPOUND}){_GIVEN}{{1,2}}|[{FAMILY}]{_GIVEN}{{1,2}})"
# What may follow a person's name in a sentence: titles, verbs of doing and telling, adverbs and particles.
_CALLED = "女士|先生|小姐|太太|老师|师傅|同学|经理|主任|医生|大夫|阿姨|叔叔|大哥|大姐|本人"
_DOES = "直接|亲自|亲手|主动|帮我|帮忙|给我|给换|替我|点个|点赞|打来|打电话|打过|签收|代签|代收|签的|收(?!到)|送来|送货|送上|上门|写的|寄来|发来|推荐|介绍|告诉|回复|处理|反映|反馈|表示|认为|觉得|建议|承诺|答应|负责|带来|拿来|说|讲|问|教|也(?=[遇说买用在有这觉给推跟是来想去帮没])|的(?:电话|手机|地址|名字|快递|包裹|服务|态度)"
_GOES_ON = "的|也|都|就|还|又|却|可|但|而|来|去|给|帮|送|签|代|正|在|把|被|从|对|跟|和|与|很|真|没|不|先|后|特别|非常|一直|已经|今天|昨天|当天|态度|服务|耐心|热情|电话|手机|地址"
_NAME_AT = regex.compile(rf"(?:[\s:：“\"「]|是|叫|为|写的是|填的是|写着){{0,3}}({_FULL_NAME})(?=$|[^\p{{L}}]|{_CALLED}|{_DOES}|{_GOES_ON})", regex.V1)
_NAME_AT_PERSON = regex.compile(rf"(?:[\s:：“\"「]|是|叫|名叫){{0,2}}({_FULL_NAME})(?=$|[^\p{{L}}\p{{N}}]|\d{{7}}|{_CALLED}|{_DOES}|{_GOES_ON})", regex.V1)
_NAME_AT_MAYBE = regex.compile(rf"({_FULL_NAME})(?=\s?(?:{_CALLED}|{_DOES}))", regex.V1)
_NAME_UP_TO = regex.compile(rf"(?<![\p{{Han}}\p{{L}}])({_FULL_NAME})\s*", regex.V1)
_RECEIVES = regex.compile(rf"[\s，,]*({_FULL_NAME})\s?(?:收(?!到)|先生|女士)", regex.V1)
_BEFORE_NUMBER = regex.compile(r"(?:护照|身份证|证件号?|电话|手机|号码|passport|id)?[\s:：(（]*$", regex.I)
_NAME_EN = regex.compile(r"[\s:]+(?:(?:mr|mrs|ms|dr|miss)\.?\s+)?(\p{Lu}[\p{L}'’]+(?:-\p{L}+)?\s+\p{Lu}[\p{L}'’]+(?:-\p{L}+)*)(?=\s*(?:[,.;!?…(\n]|at\b|in\b|on\b|for\b|and\b|who\b|said\b|$|\P{L}))", regex.I)
_CAPITAL = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}[\p{L}'’]*(?:-\p{Lu}[\p{L}'’]+)*"
_NAME_TITLE = regex.compile(rf"[\s:,]+({_CAPITAL}(?:\s+(?:de|du|van|von|da|di|la|le)\b)?\s+{_CAPITAL}(?:\s+\p{{Lu}}\p{{Ll}}+(?:вич|вна|ич))?)(?![\p{{L}}\p{{N}}])(?!\s*\p{{Lu}}{{2}}|\s*\d|\s+\p{{Lu}}\p{{Ll}}+\s*\d)")
_TITLED = regex.compile(r"\.?\s+(\p{Lu}[\p{L}'’-]+\s+\p{Lu}[\p{L}'’-]+)", regex.I)
#: Words that show that what follows a cue is a sentence, a place or a time and no name.
_NO_NAME = regex.compile(
    r"\b(?:the|a|an|my|me|it|us|you|this|that|these|before|after|and|or|is|was|for|to|at|in|on|of|customs|again|our|your|his|her|their|support|service|shop|store|seller|refund|photos|new|old|great|good|best|january|february|march|april|may|june|july|august|september|october|november|december"
    r"|monday|tuesday|wednesday|thursday|friday|saturday|sunday|christmas|easter|black|street|road|lane|avenue|city|north|south|east|west|le|les|un|une|mon|ma|votre|notre|rue|всем|вам|за|всё)\b", regex.I
)
_WORDS, _SMALL = regex.compile(r"(?<![\p{L}\p{M}])[\p{Latin}\p{Cyrillic}]{2}"), regex.compile(r"(?<![\p{L}\p{M}])\p{Ll}{2}")

_LOCAL = regex.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_])?\s*$")
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|点)\s*[\])}]\s*|\s+dot\s+|\s*点\s*)"
_DOMAIN = regex.compile(rf"\s*[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])", regex.I)
_MAIL_CUE = regex.compile(r"mail|邮|信|寄|发|联系|留了|write|reach|contact|send", regex.I)
_MAILED = regex.compile(r"[0-9._+\-]")
_LINK = regex.compile(r"(?:https?://|ftp://|www\.)[^\s\p{Han}，。！？；、）】”]+", regex.I)

_SEPARATED = r"[\s.\-–—·]{0,3}"
#: A written number from its first digit, plus or bracket on; what stands before it is looked at where it begins.
_NUMBER = regex.compile(rf"(?:(?:[(（]\+\d{{1,3}}[)）]|\+\d{{1,3}}){_SEPARATED})?(?:[(（]\d{{2,4}}[)）]{_SEPARATED})?\d(?:(?:{_SEPARATED}|[(（)）\s]{{1,2}})\d){{6,20}}(?:{_SEPARATED}[Xx](?![A-Za-z]))?(?![\d])")
_BEGINS = regex.compile(r"(?:[(（]?\+|[(（])?$")
_NOT_BEFORE = regex.compile(r"(?:(?!\p{Han})[\p{L}\p{N}]|[@._\-])$", regex.V1)
_SPOKEN = regex.compile(r"[零〇一二三四五六七八九幺](?:[\s\-]{0,2}[零〇一二三四五六七八九幺]){6,17}")
_SPOKEN_DIGITS = {c: str(k) for k, c in enumerate("零一二三四五六七八九")} | {"〇": "0", "幺": "1"}
_PASSPORT = regex.compile(r"(?<![A-Za-z0-9])[A-Za-z]{1,2}\s?\d{7,9}(?![A-Za-z0-9])")
_IBAN = regex.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_MOBILE = regex.compile(r"(?:0086|86)?1[3-9]\d{9}")
_LANDLINE = regex.compile(r"(?:0086|86)?0(?:10|2\d|[3-9]\d\d)[2-9]\d{6,7}")
_AMERICAN = regex.compile(r"1?[2-9]\d{2}[2-9]\d{6}|1?555\d{7}")
_FRENCH, _FRENCH_PAIRS = regex.compile(r"0[1-9]\d{8}"), regex.compile(r"0\d(?:[\s.\-]\d\d){4}")
_RUSSIAN = regex.compile(r"[78][3489]\d{9}")
_GROUPED = regex.compile(r"1?[\s.\-]?[(（]?\d{3}[)）]?[\s.\-]\d{3}[\s.\-]\d{4}")
_RUSSIAN_GROUPED = regex.compile(r"[78][\s\-]?[(（]?\d{3}[)）]?[\s\-]?\d{3}[\s\-]\d{2}[\s\-]?\d{2}")
_SOCIAL, _SOCIAL_GROUPED = regex.compile(r"\d{3}[\s\-.]\d{2}[\s\-.]\d{4}|\d{9}"), regex.compile(r"\d{3}([\s\-.])\d{2}\1\d{4}")
_CALL = regex.compile(r"(?:电话|手机|拨打?|致电|phone|tel\.?|tél\.?|тел\.?|call(?: me on)?)[:：\s]*$", regex.I)
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_GAP_ZH = regex.compile(r"[^\d，。！？；、!?,;\s]{0,6}[\s:：]*")
_GAP_EN = regex.compile(r"s?(?:\s*(?:no\.?|n°|№|number|num|numéro|номер|id|code|is|was|[#:]))*\s*", regex.I)

_AREA = r"(?:(?:(?<=^|[住到在址是的寄至往送于：:，,。；;！!\s])[\p{Han}--[住到在址是的寄至往送于地退货]]{3,4}|[\p{Han}--[址到于至住在]]{2})(?:省|市|县|州|自治区)\s*)?(?:(?:(?<=[省市县州\s])\p{Han}{2,3}|\p{Han}{2})(?:新区|区|县|镇|乡|街道)\s*)*"
_ROAD = r"\p{Han}{2,4}?(?:大道|大街|路|街|巷|弄|胡同|道|里)\s*[\d一二三四五六七八九十百]{1,6}\s*号"
_REST = r"(?:\s*[\d一二三四五六七八九十]{1,5}\s*(?:号楼|号院|号|栋|幢|座|单元|层|楼|室|户))*(?:\s*\p{Han}{2,6}?(?:小区|花园|公寓|大厦|新村|家园))?(?:\s*[\d一二三四五六七八九十]{1,5}\s*(?:号楼|号|栋|幢|座|单元|层|楼|室|户))*(?:\d{1,5}(?:室)?)?"
_ADDRESS_ZH = regex.compile(_AREA + _ROAD + _REST, regex.V1)
_FLAT = r"(?:apt|apartment|suite|unit|flat|room)\.?\s*#?\s*\d+[a-z]?"
_ADDRESS_EN = regex.compile(
    rf"(?<![\w-])\d{{1,5}}[a-z]?\s+(?:[a-z][a-z'’-]*\s+){{0,3}}?(?:{'|'.join(ANCHORS['en'])})\b\.?(?:,?\s+{_FLAT})?(?:\s*,\s*(?:\p{{L}}[\p{{L}}'’-]*)(?:\s+(?!apt|apartment|suite|unit|flat|room|and|please|but|was|is|the|or|so|to|for|nobody)\p{{Lu}}[\p{{L}}'’-]*)?)?(?:,?\s+{_FLAT})?", regex.I
)
_ADDRESS_FR = regex.compile(
    rf"(?<![\w-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:{'|'.join(ANCHORS['fr'])})\s+(?:(?:de|du|des|la|le|les|aux?)\s+|[ld]['’])*\p{{L}}[\p{{L}}'’-]*(?:\s+(?:(?:de|du|des|la)\s+)?\p{{Lu}}[\p{{L}}'’-]*)*(?:\s*,?\s*\d{{5}}\s+\p{{Lu}}[\p{{L}}'’-]*(?:\s+\p{{Lu}}[\p{{L}}'’-]*)?)?"
)
_ADDRESS_RU = regex.compile(
    r"(?:(?:г\.|город)\s*\p{Lu}[\p{L}-]+,?\s*)?(?:ул\.|улиц[аеы]|проспекте?|пр-т|переулок|пер\.|шоссе|бульвар|набережная)\s*\p{L}[\p{L}-]*(?:\s+\p{L}[\p{L}-]*)?,?\s*(?:д\.|дом)?\s*\d{1,4}[а-я]?(?:\s*,?\s*(?:к\.|корп\.|корпус|стр\.)\s*\d+)?(?:\s*,?\s*(?:кв\.|квартира|оф\.|офис)\s*\d+)?", regex.I
)


class Found(NamedTuple):
    kind: str
    start: int
    end: int


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Every anchor, over lower-cased text; built once a worker."""
    found = ahocorasick.Automaton()
    for kind, words in ANCHORS.items():
        for word in words:
            known = found.get(word, None)
            found.add_word(word, (known or ()) + ((kind, len(word), word[0].isalpha() and not _HAN.match(word[0]), word[-1].isalpha() and not _HAN.match(word[-1]) and word not in STEMS),))
    found.make_automaton()
    return found


def _hits(s: str) -> dict[str, list[tuple[int, int]]]:
    """Where each kind of anchor stands, in order of its ends; anchors of letters only as words."""
    lower = s.lower()
    if len(lower) != len(s):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    found: dict[str, list[tuple[int, int]]] = {}
    for last, kinds in _automaton().iter(lower):
        end = last + 1
        for kind, size, opens, closes in kinds:
            start = end - size
            if opens and start and lower[start - 1].isalpha() and not _HAN.match(lower[start - 1]):
                continue
            if closes and end < len(lower) and lower[end].isalpha() and not _HAN.match(lower[end]) and not lower.startswith("s", end):
                continue
            found.setdefault(kind, []).append((start, end))
    return found


_HIDDEN_CHARACTER = regex.compile(_HIDDEN, regex.V1)
_MOVED = regex.compile(rf"{_HIDDEN}|\\p{{Han}}\\s+\\p{{Han}}", regex.V1)
_FOLDED = str.maketrans("＠．（）－＋　", "@.()-+ ")


def _folded(text: str) -> tuple[str, list[int] | None]:
    """The text as the parsers read it, and where each of its characters stood; no list if nothing moved."""
    s = text
    if not _PLAIN.fullmatch(text):
        s = "".join(o if len(o := _ordinary(c)) == 1 else c for c in text).translate(_FOLDED)
        s = regex.sub(r"\p{Zs}", " ", s)
        if _FOREIGN.search(s):
            s = _WORD.sub(lambda m: w if len(w := _one_alphabet(m[0])) == len(m[0]) else m[0], s)
    else:
        s = s.translate(_FOLDED)
    if not _MOVED.search(s):
        return s, None
    kept = [k for k, c in enumerate(s) if not (c.isspace() or not c.isprintable()) or not _dropped(s, k)]
    if len(kept) == len(s):
        return s, None
    return "".join(s[k] for k in kept), kept


def _dropped(s: str, k: int) -> bool:
    """Hidden characters, and white space inside Chinese writing."""
    if _HIDDEN_CHARACTER.match(s[k]):
        return True
    if not s[k].isspace():
        return False
    a, b = k, k
    while a > 0 and s[a - 1].isspace():
        a -= 1
    while b + 1 < len(s) and s[b + 1].isspace():
        b += 1
    # A single space between Chinese characters may part an address from a name, so only other gaps are closed.
    return 0 < a and b + 1 < len(s) and bool(_HAN.match(s[a - 1])) and bool(_HAN.match(s[b + 1])) and not (a == b and s[a] == " ")


def _valid_date(digits: str) -> bool:
    try:
        return 1900 <= date(int(digits[:4]), int(digits[4:6]), int(digits[6:8])).year <= 2100
    except ValueError:
        return False


def _valid_identity(digits: str) -> bool:
    return _valid_date(digits[6:14]) and "10X98765432"[sum(int(d) * w for d, w in zip(digits[:17], _WEIGHTS, strict=True)) % 11] == digits[17].upper()


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _valid_iban(written: str) -> bool:
    s = "".join(written.split())
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class _Cues:
    """The anchors of one text, asked by place."""

    def __init__(self, s: str, hits: dict[str, list[tuple[int, int]]]) -> None:
        self.s, self.hits = s, hits

    def near(self, kind: str, start: int, before: int, end: int = 0, after: int = 0) -> bool:
        """Whether an anchor of the kind lies within so many characters before ``start``, or after ``end``."""
        return any((start - before <= a and b <= start) or (after and end <= a and b <= end + after) for a, b in self.hits.get(kind, ()))

    def announced(self, start: int) -> bool:
        """Whether an order, a parcel, a coupon, a device or the like stands directly before a number."""
        for kind, gap in (("not_zh", _GAP_ZH), ("not_en", _GAP_EN)):
            if any(0 <= start - b <= 24 and gap.fullmatch(self.s, b, start) for _, b in self.hits.get(kind, ())):
                return True
        return False


def _number_kind(written: str, start: int, end: int, cues: _Cues) -> str | None:
    """What a written number is, by its digits and its nearest cues; None if it isn't personal."""
    if cues.announced(start):
        return None
    digits = "".join(c for c in written if c.isdigit() or c in "Xx")
    if len(digits) == 18 and digits[:17].isdigit() and _valid_date(digits[6:14]):
        return "id_number"  # a wrong check digit is a slip of the pen
    if not digits.isdigit():
        return None
    if 13 <= len(digits) <= 19 and cues.near("account_cue", start, 28, end, 12) and _luhn(digits):
        return ACCOUNT
    if _MOBILE.fullmatch(digits) or _LANDLINE.fullmatch(digits):
        return "phone"
    bare, called = written.strip(), cues.near("phone_cue", start, 16)
    if _SOCIAL_GROUPED.fullmatch(bare):
        return "id_number"
    if cues.near("id_cue", start, 28, end, 24) and (_SOCIAL.fullmatch(bare) or (len(digits) == 15 and (_valid_date("19" + digits[6:12]) or digits[0] in "12")) or (len(digits) == 10 and not called and not _GROUPED.fullmatch(bare))):
        return "id_number"
    if "+" in written and 8 <= len(digits) <= 15:
        return "phone"
    if len(digits) in (10, 11) and (_GROUPED.fullmatch(bare) or _FRENCH_PAIRS.fullmatch(bare) or _RUSSIAN_GROUPED.fullmatch(bare) or (called and (_AMERICAN.fullmatch(digits) or _FRENCH.fullmatch(digits) or _RUSSIAN.fullmatch(digits)))):
        return "phone"
    if len(digits) in (7, 8) and _CALL.search(cues.s, max(0, start - 14), start):
        return "phone"
    return None


def _mail(s: str, start: int, end: int) -> Found | None:
    left, right = _LOCAL.search(s, max(0, start - 70), start), _DOMAIN.match(s, end)
    if not left or not right:
        return None
    if s[start:end] == " at " and not (_MAILED.search(left[0]) or _MAIL_CUE.search(s[max(0, left.start() - 20) : left.start()])):
        return None
    return Found("email", left.start(), right.end())


def _numbers(s: str, cues: _Cues) -> Iterator[Found]:
    """Numbers expanded from their first digit: accounts, passports, and written and spoken numbers."""
    for start, end in ((m.start(), m.end()) for at, _ in cues.hits.get("digit", ()) if at >= 2 and s[at - 2 : at].isalpha() and s[at - 2 : at].isupper() and (m := _IBAN.match(s, at - 2))):
        if _valid_iban(s[start:end]):
            yield Found(ACCOUNT, start, end)
    done = 0
    for at, _ in cues.hits.get("digit", ()):
        if at < done or (at and s[at - 1].isdigit()):
            continue
        for back in (1, 2, 3):
            if at >= back and s[at - back].isascii() and s[at - back].isalpha() and (m := _PASSPORT.match(s, at - back)):
                if not cues.announced(m.start()) and cues.near("id_cue", m.start(), 32, m.end(), 24):
                    yield Found("id_number", m.start(), m.end())
                break
        # A plus or a bracket before it may be the number's own, or a bracket may hold the whole number.
        starts = range(_BEGINS.search(s, max(0, at - 2), at).start(), at + 1)
        m = next((m for k in starts if not _NOT_BEFORE.search(s, max(0, k - 1), k) and (m := _NUMBER.match(s, k))), None)
        if not m:
            continue
        done = m.end()
        if kind := _number_kind(m[0], m.start(), m.end(), cues):
            yield Found(kind, m.start(), m.end())
    done = 0
    for at, _ in cues.hits.get("spoken", ()):
        if at >= done and (m := _SPOKEN.match(s, at)):
            done = m.end()
            if kind := _number_kind("".join(_SPOKEN_DIGITS.get(c, c) for c in m[0]), m.start(), m.end(), cues):
                yield Found(kind, m.start(), m.end())


def _names(s: str, hits: dict[str, list[tuple[int, int]]]) -> Iterator[Found]:
    """Names expanded from the words before or after them; the surer cues first."""
    for _, end in hits.get("name", ()):
        if m := _NAME_AT.match(s, end):
            yield Found("name", *m.span(1))
    for kind, pattern in (("person", _NAME_AT_PERSON), ("maybe", _NAME_AT_MAYBE)):
        for _, end in hits.get(kind, ()):
            if (m := pattern.match(s, end)) and m[1][:2] not in WORDS_LIKE_NAMES:
                yield Found("name", *m.span(1))
    for start, _ in hits.get("after", ()):
        for m in _NAME_UP_TO.finditer(s, max(0, start - 6), start):
            if m.end() == start:
                yield Found("name", *m.span(1))
    for _, end in hits.get("titled", ()):
        if (m := _TITLED.match(s, end)) and not _NO_NAME.search(m[1]):
            yield Found("name", *m.span(1))
    for _, end in hits.get("name_en", ()):
        if (m := _NAME_EN.match(s, end)) and not _NO_NAME.search(m[1]):
            yield Found("name", *m.span(1))
    if any(k in hits for k in ("title_en", "title_fr", "title_ru", "name_en")) and (_SMALL.search(s) or len(_WORDS.findall(s)) < 7):
        for kind in ("title_en", "title_fr", "title_ru", "name_en"):
            for _, end in hits.get(kind, ()):
                if (m := _NAME_TITLE.match(s, end)) and not _NO_NAME.search(m[1]):
                    yield Found("name", *m.span(1))


def _beside(s: str, known: list[Found]) -> Iterator[Found]:
    """Names directly before an identity number or a phone number, and after an address before the word for receiving."""
    for f in known:
        if f.kind in ("id_number", "phone"):
            offset = max(0, f.start - 14)
            head = _BEFORE_NUMBER.sub("", s[offset : f.start])
            for m in _NAME_UP_TO.finditer(head):
                if m.end() == len(head) and m[1][:2] not in WORDS_LIKE_NAMES:
                    yield Found("name", offset + m.start(1), offset + m.end(1))
        elif f.kind == "address" and (m := _RECEIVES.match(s, f.end)):
            yield Found("name", *m.span(1))


def find(text: str) -> list[Found]:
    """Every occurrence of personal data, in the text's own positions, by start; they don't overlap."""
    s, kept = _folded(text)
    taken: list[Found] = []

    def take(found: Iterator[Found]) -> None:
        for f in found:
            if f.start < f.end and all(f.end <= t.start or f.start >= t.end for t in taken):
                taken.append(f)

    hits = _hits(s)
    cues = _Cues(s, hits)
    take(Found("link", start, m.end()) for start, _ in hits.get("link", ()) if (m := _LINK.match(s, start)))
    take(f for start, end in hits.get("at", ()) if (f := _mail(s, start, end)))
    for kind, pattern in (("zh", _ADDRESS_ZH), ("fr", _ADDRESS_FR), ("en", _ADDRESS_EN), ("ru", _ADDRESS_RU)):
        if kind in hits:
            take(Found("address", *m.span()) for m in pattern.finditer(s))
    take(_numbers(s, cues))
    take(_names(s, hits))
    take(_beside(s, list(taken)))
    found = sorted((f for f in taken if f.kind != "link"), key=lambda f: f.start)
    if kept is not None:
        found = [Found(f.kind, kept[f.start], kept[f.end - 1] + 1) for f in found]
    return found


def masked(text: str) -> str:
    """The text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]``; the rest stays as it is."""
    parts, at = [], 0
    for f in find(text):
        parts += [text[at : f.start], f"[{f.kind.upper()}]"]
        at = f.end
    return "".join([*parts, text[at:]])


def occurrences(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record_id, kind, nth``: every occurrence, numbered from 1 within its kind and text.

    Null and empty texts have none; a repeated row gives its occurrences again. One Arrow hop, no shuffle; whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[str, int] = {}
                for f in find(t) if t else ():
                    seen[f.kind] = seen.get(f.kind, 0) + 1
                    for column, value in zip(out, (i, f.kind, seen[f.kind]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["record_id", "kind", "nth"])

    return map_batches(pick(df, record_id=record, text=text), run, "record_id bigint, kind string, nth bigint")


def redacted(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record_id, text``: every text with its personal data replaced by typed placeholders; null stays null."""
    rows = pick(df, record_id=record, source=text)
    return map_batches(rows, text_column(masked, "source", "text", pa.string()), "record_id bigint, text string")


def kinds_report(df: DataFrame, record: str, text: str) -> DataFrame:
    """``kind, occurrences, records``: how much of each kind there is."""
    return occurrences(df, record, text).groupBy("kind").agg(F.count("*").alias("occurrences"), F.sum((F.col("nth") == 1).cast("bigint")).alias("records"))
