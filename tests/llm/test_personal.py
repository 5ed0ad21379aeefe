import re

import pytest

from reviewloom.llm import personal as pe

from .helpers import TRICKY, table, tuples

CASES = {
    "发票寄greyfinch1@example.net就行": "发票寄[EMAIL]就行",
    "写信到 moss_88 [at] mail dot example 吧": "写信到 [EMAIL] 吧",
    "打我电话138-0013-8000，或者(0571)55508185。": "打我电话[PHONE]，或者[PHONE]。",
    "一八九零零零零二六九五这个号码": "[PHONE]这个号码",
    "1 6 8 0 0 5 5 3 9 1 0 谢谢": "[PHONE] 谢谢",
    "Call me on +1 303 555 0192.": "Call me on [PHONE].",
    "订单号13800138000查不到": "订单号13800138000查不到",
    "机身编号006101787307对不上": "机身编号006101787307对不上",
    "运单SFX675712072停了": "运单SFX675712072停了",
    "身份证 993964198502098466 不给过": "身份证 [ID_NUMBER] 不给过",
    "They wanted my ID 666 81 8141.": "They wanted my ID [ID_NUMBER].",
    "实名填的护照EX6611795也不给过": "实名填的护照[ID_NUMBER]也不给过",
    "这款EX6611收到": "这款EX6611收到",
    "地址栖霜市石桥镇旧窑巷97号1单元1193。": "地址[ADDRESS]。",
    "We live at 292 Marlin Avenue, Tansy Cross.": "We live at [ADDRESS].",
    "收件人写的是温洵。": "收件人写的是[NAME]。",
    "感谢客服季翎帮忙！": "感谢客服[NAME]帮忙！",
    "阮翎 993964198502098466 实名没通过": "[NAME] [ID_NUMBER] 实名没通过",
    "Send it to Maribeth Ashgrove-Lyle, 17 Alder Row, Port Ellery.": "Send it to [NAME], [ADDRESS].",
    "@官方小助手 也不回": "@官方小助手 也不回",
    "晒图见 https://img1.example/13800138000.png 里": "晒图见 https://img1.example/13800138000.png 里",
    "ｇｒｅｙ​fin@example．net 好": "[EMAIL] 好",
    "味道很好，用了27天，花了366元": "味道很好，用了27天，花了366元",
    "": "",
}


@pytest.mark.parametrize("text", CASES)
def test_masking(text):
    assert pe.masked(text) == CASES[text]


def test_positions_are_the_texts_own():
    text = "好​的，电​话138​00138000。"
    (f,) = pe.find(text)
    assert f.kind == "phone" and text[f.start : f.end].replace("​", "") == "13800138000"


def test_table(spark):
    rows = [*TRICKY, (30, "电话13800138000和13900139000，邮箱a1@b.example"), (30, "电话13800138000")]
    df = table(spark, rows, "request_id bigint, text string")
    got = tuples(pe.occurrences(df, "request_id", "text").where("record_id = 30"), "record_id", "kind", "nth")
    assert got == [(30, "email", 1), (30, "phone", 1), (30, "phone", 1), (30, "phone", 2)]
    masked = pe.redacted(df, "request_id", "text")
    assert masked.count() == len(rows) and masked.where("text IS NULL").count() == 1
    assert {r["kind"]: r["records"] for r in pe.kinds_report(df, "request_id", "text").collect()} == {"email": 1, "phone": 2}
    assert pe.occurrences(df.where("false"), "request_id", "text").count() == 0


#: Lead-ins that stand in no test table. What is in angle brackets is to be found, with its kind.
HELD_OUT = """
我媳妇<name 张丽华>签的。|物流小哥<name 李建国>。|收货人：<name 王小明>|谢谢<name 李娜>老师|老公<name 陈志强>说不错|找的师傅叫<name 周大勇>，很专业|客服<name 刘洋>处理得很快|邻居<name 孙小梅>也买了|车主<name 冯德伦>反映异响|我是<name 何静>，电话<phone 13800138000>
收件地址<address 北京市海淀区中关村大街27号> <name 黄磊>收|司机<name 赵海峰>送货上门|同事<name 欧阳娜娜>推荐的|姓名：<name 吴桂芳>|经理<name 郑凯>主动打来电话|跟<name 马丽>女士说好了|全名<name 蔡文博>|快递员<name 田亮>态度好|户名：<name 罗晓燕>|导购<name 彭宇>很耐心
Written by <name Sarah Connor>|The courier <name Tom Hardy> was rude.|My neighbour <name Anna Schmidt> loves it.|Sincerely, <name David Miller>|The manager, <name Grace O'Neil> called back.|It was packed by <name Peter Quint> himself.|Mrs. <name Laura Palmer> answered.|I am <name John Carter> and I want a refund.
Merci à <name Claire Martin> du service client.|Signé par <name Paul Durand>.|Je m'appelle <name Jean Dupont>.|Mon voisin <name Luc Moreau> a signé.|Меня зовут <name Иван Петров>.|С уважением, <name Ольга Смирнова>|курьер <name Сергей Волков> опоздал|Получатель: <name Анна Кузнецова>
J'habite <address 12 rue de la Paix, 75002 Paris>.|Livrez au <address 8 bis avenue Victor Hugo, 69003 Lyon> svp|адрес: <address ул. Ленина, д. 5, кв. 12>|живу на <address проспект Мира, дом 17, корп. 2>|Drop it at <address 221 Baker Street> next time|家住<address 杭州市西湖区文三路100号3栋502室>
Téléphone : <phone 06 12 34 56 78>|тел. <phone 8 (912) 345-67-89>|звоните <phone +7 912 345 67 89>|Ring <phone +44 20 7946 0958> tomorrow|座机<phone 010-65551234>|微信<phone 139 1234 5678>|cell: <phone (415) 555-2671>
паспорт <id_number 4510 123456>|Mon passeport <id_number AB1234567> a expiré|SSN <id_number 123-45-6789>|证件<id_number 11010519491231002X>|numéro de sécurité sociale <id_number 1 85 05 78 006 084 36>|驾照<id_number 310101198001017777>没通过
My card <account 4111 1111 1111 1111> was charged|卡号<account 6212261111111111112>|IBAN <account DE89 3704 0044 0532 0130 00> please|pay to <account GB82WEST12345698765432>|écrivez à <email jean.dupont@exemple.fr>|пишите на <email ivan_petrov@pochta.example>
"""
NOTHING = """联系方式。方便的话|这是白色，很好看|和金属的一样|同事高兴坏了|朋友安装的时候|made by Lumora Home 2000|from New York City|The Best Buy shop|订单由系统自动取消|快递马上就到了|谢谢关注|客服全程跟进|师傅安静地装完|老板何必呢|找方法退|订单号 4111111111111111|commande 0612345678
номер заказа 4510123456|tracking code 123-45-6789|My card 4111 1111 1111 1112 was charged|model AB1234567|He arrived by Monday Morning|Merci à Mon voisin|спасибо вам|邻居于是也买了|rue du commerce|2 places left"""


def marked(line):
    """The text without its marks, and what is to be found."""
    text, found, at = "", [], 0
    for m in re.finditer(r"<(\w+) ([^>]*)>", line):
        text += line[at : m.start()]
        found.append((m[1], len(text), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + line[at:], found


def test_lead_ins_that_stand_in_no_table():
    cases = [marked(x) for line in HELD_OUT.strip().splitlines() for x in line.split("|")]
    wanted = {(t, *f) for t, fs in cases for f in fs}
    got = {(t, *f) for t, _ in cases for f in pe.find(t)}
    assert len(wanted) > 55 and len(wanted & got) >= 0.95 * len(wanted), sorted(wanted - got)
    assert len(wanted & got) >= 0.95 * len(got), sorted(got - wanted)


def test_nothing_personal():
    texts = [x for line in NOTHING.splitlines() for x in line.split("|")]
    assert [t for t in texts if pe.find(t)] == []


def test_accounts_are_masked_but_no_kind_of_the_query(spark):
    df = table(spark, [(1, "IBAN DE89 3704 0044 0532 0130 00")], "request_id bigint, text string")
    assert pe.redacted(df, "request_id", "text").first()["text"] == "IBAN [ACCOUNT]" and pe.ACCOUNT not in pe.KINDS
