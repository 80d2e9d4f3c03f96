"""Scalar functions on the worked examples of FIXTURES.md."""

import pytest

from shelfwise.functions import pagetext as pg
from shelfwise.functions import tags, urls, words
from shelfwise.functions import text as tx
from shelfwise.functions import weight as wt


def test_sales_ranges(one):
    got = one(tx.sales_range, "1234", "1,234", "100+", "600+", "5000+", "20000+", "1.5万+", "3千+", "已售100+", "", None)
    assert [tuple(r) for r in got] == [
        (1234, 1234, "high"), (1234, 1234, "high"), (100, 500, "low"), (600, 500, "low"), (5000, 10000, "medium"), (20000, 100000, "medium"),
        (15000, 75000, "medium"), (3000, 15000, "medium"), (None, None, "low"), (None, None, None), (None, None, None),
    ]
    assert one(lambda c: tx.sales_range(c, "monotone"), "600+")[0].upper == 600


def test_numbers_and_magnitudes(one):
    assert one(tx.first_number, "110.1 110.1 100+", "￥1,299.00", "", None) == [110.1, 1299.0, None, None]
    assert one(lambda c: tx.first_number(c, signed=True), "-3.5元") == [-3.5]
    assert one(tx.magnitude, "100+", "1万+", "1.5万+", "5000+", "2亿", "3w", "", None) == [100, 10000, 15000, 5000, 2e8, 30000, 0, 0]
    assert one(lambda c: tx.magnitude(c, None), "x") == [None]


def test_keys(one):
    assert one(tx.normalize_key, "1.00024E+11", "123.0", "nan", " 77 ", "None") == ["100024000000", "123", "", "77", ""]
    assert one(lambda c: tx.normalize_key(c, "longest_run"), "a12b100012", "a1b22c33") == ["100012", "22"]


def test_blanks_and_unicode_trim(one):
    assert one(tx.clean_text, "　a b\t", "NaN", None) == ["a b", "", ""]
    assert one(tx.nonempty, "x", " none ", "NaT", None, "") == [True, False, False, False, False]


def test_brands_and_categories(one):
    assert one(tx.clean_brand, "良品铺子 - 坚果零食") == ["良品铺子"]
    assert one(lambda c: tx.clean_brand(c, "dash"), "三只松鼠-休闲食品") == ["三只松鼠"]
    assert one(lambda c: tx.clean_brand(c, "any", True), "洽洽旗舰店 | x") == ["洽洽"]
    got = one(tx.category_levels, "A > B > C", "B > C", "京东排行榜 > x", "A > 热卖榜", "A > B > C > D")
    assert [tuple(r) for r in got] == [("A", "B", "C"), ("", "B", "C"), ("", "", ""), ("", "", ""), ("B", "C", "D")]
    assert tuple(one(lambda c: tx.category_levels(c, "left"), "A > B > C > D")[0]) == ("A", "B", "C")


def test_bands_are_right_open_or_closed(one):
    bounds, labels = words.POSITION_BANDS
    assert one(lambda c: tx.band(c, bounds, labels), 20.0, 19.99, 5000.0, None, kind="double") == ["20-50元", "0-20元", "1000元以上", "未知"]
    assert one(lambda c: tx.band(c, bounds, labels, closed="right"), 20.0, kind="double") == ["0-20元"]
    assert one(tx.confidence_label, 80, 30, 10, 9, kind="int") == ["高", "中", "低", "不足"]


def test_promotions(one):
    assert one(tx.promotion_kind, "", "[]", "券满9减1", "满99减10", "限时秒杀", "包邮", "新人") == ["无促销", "无促销", "优惠券/礼金", "满减", "限时特价/折扣", "包邮", "其他促销"]
    assert one(tx.promotion_keywords, "['新品', '券满29减1', '包邮', '包邮x']", "满减 包邮；百亿补贴", "[]") == [["新品", "满减", "包邮"], ["满减", "包邮", "百亿补贴"], []]
    assert one(tx.keyword_list, '["a","b"]', "['a', 'b ']", "a;b，c|d", "") == [["a", "b"], ["a", "b"], ["a", "b", "c", "d"], []]


def test_strict_weights(one):
    assert one(wt.weight_strict, "750g/3包", "30g/包", "1.5kg", "2公斤", "1斤装", "500-1000g", "30包/箱", "礼品1500", None) == [750, 30, 1500, 2000, 500, None, None, 1500, None]
    assert one(wt.weight_multi, "60g*5袋", "1kg x2", "1.5kg") == [300, 2000, 1500]


TITLES = [
    ("良品铺子坚果零食高端礼盒大礼包送人走亲戚年货送长辈健康礼物品 【龙跃凤鸣】买一送一共24款（实发2箱共1816g）", 1816, "括号优先-强信号重量", "", "礼盒;礼包;箱装", "系列:龙跃凤鸣;共24款;买1送1;2箱", True),
    ("良品铺子 蟹黄味腰果60g果仁坚果每日干果零食解馋小吃 蟹黄味腰果60g*5袋", 300, "倍数重量", "蟹黄味", "袋装", "5袋", False),
    ("洽洽小黄袋每日坚果26g*10袋独立小包装混合坚果仁果干健康休闲零食", 260, "倍数重量", "", "独立包装;袋装;小包装", "10袋", False),
    ("三只松鼠 奶油味夏威夷果265gx2袋 坚果炒货 年货零食", 530, "倍数重量", "奶油味", "袋装", "2袋", True),
    ("百草味 麻辣牛肉条100g 肉类零食 休闲小吃", 100, "普通重量", "麻辣", "", "", False),
]


@pytest.mark.parametrize("title,weight,note,flavor,package,spec,gift", TITLES)
def test_structured_titles(one, title, weight, note, flavor, package, spec, gift):
    from pyspark.sql import functions as F

    name = tx.normalize_text
    assert tuple(one(wt.weight_structured, title)[0]) == (weight, note)
    assert one(lambda c: F.array_join(tags.flavor_tags(name(c)), ";"), title) == [flavor]
    assert one(lambda c: F.array_join(tags.package_tags(name(c)), ";"), title) == [package]
    assert one(lambda c: F.array_join(tags.specification(name(c)), ";"), title) == [spec]
    assert one(lambda c: tags.is_gift(name(c)), title) == [gift]


def test_weight_rules(one):
    got = one(wt.weight_structured, "每袋 3袋*20g", "100-200g 混合", "净重:1.5kg", "500g/3包", "无")
    assert [tuple(r) for r in got] == [(60, "反向倍数重量"), (150, "范围重量均值"), (1500, "强信号重量"), (500, "普通重量"), (None, "未识别重量")]


def test_numerals(one):
    assert one(tags.numeral_value, "十七", "二百零五", "两", "一万二千", "12", "2千", "x", "百") == [17, 205, 2, 12000, 12, None, None, 100]


def test_urls(one):
    share = "//3.cn/2-ObrTbe?jkl=@U5OlD6VEhxs0@ MF8335 「三只松鼠巨型零食大礼包送女友」 点击"
    assert one(urls.url_candidate, share) == ["//3.cn/2-ObrTbe?jkl=@U5OlD6VEhxs0@"]
    assert one(urls.fetchable_url, share) == ["https://3.cn/2-ObrTbe?jkl=@U5OlD6VEhxs0@"]
    assert one(pg.shared_title, share) == ["三只松鼠巨型零食大礼包送女友"]
    assert one(urls.canonical_url, "https://item.taobao.com/item.htm?id=123456789012&spm=1&foo=bar", "https://detail.tmall.com/item.htm?id=998877665544&abbucket=1&skuId=123") == [
        "https://item.taobao.com/item.htm?id=123456789012", "https://detail.tmall.com/item.htm?id=998877665544"]
    assert one(urls.product_id, "https://item.jd.com/100024252308.html", "123456", "https://x.com/a?skuId=7654321", "no") == ["100024252308", "123456", "7654321", ""]
    assert one(lambda c: urls.set_query_params(c, {"page": "2"}), "http://a/b?x=1&page=9#t", "http://a/b") == ["http://a/b?x=1&page=2#t", "http://a/b?page=2"]


def test_page_text(one):
    assert one(pg.spoken_price, "商品促销信息 到手价 ￥59.90 规格 750g", "520 大礼包 1000g") == [59.9, None]
    assert one(pg.html_title, '<meta property="og:title" content="A &amp; B - 京东 x">', "<title> t </title>", "") == ["A & B", "t", ""]
    assert one(pg.html_price, '{"p":"0","price":"12.5"}') == [12.5]
    card = "广告\n三只松鼠坚果\n￥\n19\n.\n90\n已售1.2w+\n满99减10\n三只松鼠旗舰店"
    assert one(pg.card_prices, card) == [[19.9]]
    assert one(pg.card_sales, card) == ["1.2万+"]
    assert one(pg.card_shop, card) == ["三只松鼠旗舰店"]
    assert one(pg.card_title, card) == ["三只松鼠坚果"]
    assert one(pg.card_promotions, card) == [["满99减10"]]
    assert one(pg.review_score, "评分：4", "3星", "star5", "差评", "一般", "好评", "x") == [4, 3, 5, 1, 3, 5, None]
    assert one(pg.nfkc, "Ａ１㎏") == ["A1kg"]


def test_question_expressions(one):
    from shelfwise.operators import questions as qs

    got = one(qs.scene, "库存积压怎么清仓", "hello", "选品和促销")
    assert [(r.scene, round(r.confidence, 2)) for r in got] == [("clearout", 1.0), ("pick", 0.3), ("pick", 0.5)]
    assert one(qs.intent, "满减活动", "品牌定价", "随便") == ["promotion", "brand_strategy", "smart_selection"]
    assert one(qs.price_cap, "100元以内 坚果", "x") == [100.0, None]


def test_brand_rules(one):
    from shelfwise.operators import extraction as ex

    got = one(ex.canonical_brand, "【京东超市】乐事薯片", "Lay's chips", "Abc nuts", "好吃点坚果礼盒", "1")
    assert [tuple(r) for r in got] == [("乐事", "brand_dictionary"), ("乐事", "brand_dictionary"), ("Abc", "leading_token"), ("好吃点坚", "leading_feature"), ("", "")]
    assert one(ex.quoted_or_known_brand, "「某牌」x", "（新牌）y", "（12包）洽洽瓜子", "zz") == ["某牌", "新牌", "洽洽", None]
    got = one(ex.fill_brand, "Calbee 麦片", "【新】2025代购 好味道饼干", "零食大礼包", "【】")
    assert [tuple(r) for r in got] == [("updated_alias", "卡乐比"), ("updated_prefix", "好味道饼干"), ("skip_generic", "零食大礼包"), ("skip_empty", "")]


def test_compatibility_forms_fold_like_nfkc(one):
    import unicodedata

    texts = ["坚果 500㎏ 装", "①½ﬁ㎖℃™…", "Ａｂｃ，；：　！", "plain text 12", "三只松鼠【礼盒】", "", None]
    assert one(tx.compatible, *texts) == [t and unicodedata.normalize("NFKC", t) for t in texts]
    assert one(lambda c: wt.weight_structured(c)["weight_g"], "坚果 500㎏ 装") == [500_000.0]


def test_page_fields_in_any_attribute_order(one):
    pages = [
        '<meta content="A &amp; B" property="og:title">', "<META name='title' data-x=1 content='C'>", '<title lang="x">D</title>', '{"skuName":"E"}', "none",
    ]
    assert one(pg.html_title, *pages) == ["A & B", "C", "D", "E", ""]
    assert one(pg.spoken_price, "到手价：123456.5元", "¥ 7", "卖 12元", "x") == [123456.5, 7.0, 12.0, None]
    assert one(pg.good_rate, "好评度: 98%", "超99%买家赞不绝口", "推荐度很高 97.5%", "") == ["98%", "99%", "97.5%", ""]
    assert one(pg.review_score, "4星", "star_2", "一般般", "评分: 5", "x") == [4, 2, 3, 5, None]
    assert one(pg.like_count, "点赞 12", "3人觉得有用", "x") == [12, 3, 0]


def test_coupons_and_stated_lows(spark, one):
    from shelfwise.operators import history

    assert one(history.coupon, "优惠券：满99减10，其他", "满 200 减 20 全场", "券后 9.9", "5元券", "8折", "立减3", "x") == ["满99减10", "满 200 减 20 全场", "券后 9.9", "5元券", "8折", "立减3", ""]
    rows = spark.createDataFrame([(1, "a\n25个月历史最低价：¥ 9.5\n2024.3.7\n60天均价 12"), (2, "25个月历史最低\n于 2023-01-02 记录\n¥ 8.8"), (3, "none")], "k int, t string")
    got = {r.k: (r.lowest_price, str(r.lowest_date), r.avg_60d) for r in history.stated_lows(rows, "k", "t").collect()}
    assert got == {1: (9.5, "2024-03-07", 12.0), 2: (8.8, "2023-01-02", None), 3: (None, "None", None)}


def test_a_coupon_is_the_clause_around_its_leftmost_word(one):
    from shelfwise.operators import history

    told = one(history.coupon, "满意的商品，满99减10", "打折促销，8折", "到手价 9 优惠券：新人专享。满2件", "5元券满50可用，立减3", "满意", "", None)
    assert told == ["满99减10", "8折", "新人专享", "5元券满50可用", "", "", ""]


def test_numerals_beyond_the_tens_of_thousands(spark, one):
    from shelfwise.plans.lookups import chinese_numeral

    assert one(tags.numeral_value, "十二万三千", "一亿", "三亿零五十万", "一万二千亿", "一亿亿", "九亿亿亿亿") == [123000, 10**8, 300500000, 1200000000000, 10**16, None]
    numbers = [0, 9, 10, 20000, 99999, 100000, 100005, 7200000, 10**8, 10**8 + 5, 123456789012, 10**16 + 1, 2**63 - 1]
    assert one(lambda c: tags.numeral_value(chinese_numeral(c)), *numbers, kind="long") == numbers


def test_a_reference_without_its_semicolon_stays_text_if_asked(one):
    assert one(lambda c: pg.html_title(c, terminated=True), "<title>a &amp; b &amp</title>", "<title>&amp;lt &lt;c&gt;</title>") == ["a & b &amp", "&lt <c>"]
    assert one(pg.html_title, "<title>a &amp; b &amp</title>") == ["a & b &"]


def test_edges_of_any_white_space_go_and_long_forms_fold(one):
    from shelfwise.functions import text as tx

    blanks = [chr(c) for c in range(1, 0x10000) if chr(c) in tx.BLANKS]
    assert len(blanks) == 25 and one(tx.strip, *[f"{b}a{b}b{b}" for b in blanks]) == [f"a{b}b" for b in blanks]
    assert one(tx.compatible, "㎏ﬁ①【a】", "【a】", "㎏") == ["kgfi1【a】", "【a】", "kg"]


def test_whole_addresses_are_told_at_once_and_a_known_canonical_form_is_used(spark, one):
    got = one(urls.url_candidate, "//a.b/c?x=1", "//a.b/c?u=http://x.y/1", "https://a.b/c", "HTTPS://a.b/c", "http://a.b/c\n", "http://a.b/'c", "看 //a.b/c")
    assert got == ["//a.b/c?x=1", "http://x.y/1", "https://a.b/c", "HTTPS://a.b/c", "http://a.b/c", "http://a.b/", "//a.b/c"]
    df = spark.createDataFrame([("//a.b/p", "https://c.d/123456.html")], "x string, known string")
    assert df.select(urls.product_id("x", canonical=df["known"])).first()[0] == "123456"


def test_card_fields_from_known_lines(one):
    cards = ["广告\nA b\n￥\n12\n.\n5\n已售 3w+\n券后立省", "x\r￥5", "￥1\nlate"]
    for f, want in ((pg.card_title, ["A b", "x\r", ""]), (pg.card_prices, [[12.5], [5.0], [1.0]]), (pg.card_promotions, [["券后立省"], [], []])):
        assert one(lambda c: f(c, pg.lines(c)), *cards) == one(f, *cards) == want
    assert one(pg.card_sales, *cards) == ["3万+", "", ""]


def test_package_words_are_looked_for_by_their_common_characters(one):
    assert tags._common_characters(["礼盒装", "礼品盒", "小包"]) == ["礼", "小"]
    assert one(tags.package_tags, "礼袋 十袋", "x袋", "3罐", "", None) == [["礼包", "袋装"], [], ["罐装"], [], []]
    assert one(lambda c: tx.clean_brand(c, "any", True), "官方 旗舰店", "A食品零食 | b", "零食") == ["官方", "A食品", ""]


def test_a_plain_text_is_only_trimmed_and_a_long_one_takes_the_whole_way(spark, one):
    assert one(tx.normalize_text, " 【Ab】 3g*5袋 ", "a  b", "3×5", "a、b", "Ａ", None, "") == ["【Ab】 3g*5袋", "a b", "3x5", "a b", "A", "", ""]
    assert one(tx.normalize_text, "a袋" * 100_000) == ["a袋" * 100_000]
    assert tx._PLAIN
