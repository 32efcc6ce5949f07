"""Values that results depend on: word lists, priorities and codes. All are fixed values."""

from __future__ import annotations

# Classification of events.
CONCERT, BASEBALL, OTHER = "コンサート", "野球", "その他"
BASEBALL_WORDS = ("野球", "ベースボール", "baseball", "npb", "プロ野球", "甲子園", "侍ジャパン", "オープン戦", "公式戦", "ファーム", "クライマックスシリーズ", "日本シリーズ", "セ・リーグ", "パ・リーグ", "交流戦")
TEAM_WORDS = (
    "オリックス", "バファローズ", "阪神", "タイガース", "巨人", "ジャイアンツ", "ヤクルト", "スワローズ", "広島", "カープ", "中日", "ドラゴンズ", "dena", "ベイスターズ", "ベイス",
    "ソフトバンク", "ホークス", "日本ハム", "日ハム", "ファイターズ", "楽天", "イーグルス", "西武", "ライオンズ", "ロッテ", "マリーンズ",
)
VERSUS_WORDS = ("vs", "ｖｓ", "対", " 対戦 ")
NON_MUSIC_WORDS = (
    "就活", "就職", "説明会", "展示会", "見本市", "expo", "フェア", "学会", "式典", "授与式", "卒業式", "入学式", "サッカー", "j1", "acl", "チャンピオンズリーグ", "フットサル", "マラソン",
    "グランプリ", "大会", "カップ", "m-1", "スポーツフェスティバル",
)
#: Those that only the newer of the two classifiers knows.
NON_MUSIC_NEWER = ("j1", "acl", "チャンピオンズリーグ")
CONCERT_WORDS = (
    "ライブ", "コンサート", "音楽イベント", "公演", "ツアー", "フェス", "リサイタル", "オーケストラ", "music", "concert", "festival", "band", "gig", "live", "tour", "dome", "arena", "hall",
    "zepp", "oneman", "one man", "world tour", "fan meeting", "showcase", "弾き語り", "ワンマン", "ワールドツアー", "ドームツアー", "アリーナツアー",
)
RESALE_CONCERT_GROUPS = ("live_domestic", "live_international")
RESALE_CONCERT_SLUGS = ("music", "band", "idol", "classical", "jazz", "fusion", "festival", "artist")
RESALE_BASEBALL = ("baseball", "yakyu", "npb")
LABEL_CATEGORIES = {"concert": CONCERT, "music": CONCERT, "musicevent": CONCERT, "music_event": CONCERT, "baseball": BASEBALL, "baseballevent": BASEBALL, "baseball_event": BASEBALL, "other": OTHER}
SOURCE_CATEGORIES = {"starto_concert": CONCERT, "kstyle_music": CONCERT}

# Spending items, in the order in which a bucket is chosen.
SPEND_BUCKETS = (
    ("宿泊", ("宿泊",)),
    ("飲食", ("飲食",)),
    ("交通", ("交通", "鉄道", "バス", "タクシー", "レンタカー", "航空", "船舶", "Rail Pass")),
    ("買物", ("買物", "菓子", "酒", "食料", "化粧", "医薬", "健康", "衣類", "靴", "かばん", "革製品", "電気製品", "時計", "宝石", "民芸品")),
    ("娯楽", ("娯楽", "ツアー", "テーマパーク", "舞台", "音楽", "スポーツ", "美術館", "博物館", "温泉", "マッサージ", "コンベンション")),
)
OTHER_BUCKET = "その他"

# Consolidation.
SOURCE_PRIORITY = {"official_events": 10, "venue_web_discovery": 20, "starto_concert": 30, "kstyle_music": 30, "ticketjam_events": 40}
LAST_PRIORITY = 999

# Artist inference.
AMBIGUOUS_SIGNS = ("京", "阪", "東", "西", "南", "北", "中")
AMBIGUOUS_ALIASES = ("ベン", "たま", "ナビ", "声", "dream", "one", "rsp", "summer", "wqwq", "わくわく", "るい")
GENERIC_ALIASES = (
    "dome", "arena", "hall", "live", "tour", "concert", "show", "showcase", "festival", "fes", "oneman", "onelive", "fanmeeting", "ticket", "open", "start", "vol", "part", "event", "music",
    "special", "the", "with", "and", "dream", "ライブ", "コンサート", "ツアー", "公演", "イベント", "フェス", "ワンマン", "ドーム", "アリーナ", "ホール",
)
MUSIC_HINTS = (
    "ライブ", "コンサート", "公演", "ツアー", "フェス", "ファンミ", "リサイタル", "オーケストラ", "弾き語り", "ワンマン", "fan meeting", "world tour", "tour", "concert", "live", "showcase", "dome",
    "arena", "hall", "zepp", "oneman", "one man",
)
NON_MUSIC_EXCLUDES = (
    "vs", "ｖｓ", "対戦", "リーグ", "野球", "baseball", "wbc", "ラグビー", "サッカー", "バスケット", "中日", "阪神", "巨人", "ヤクルト", "広島", "ドラゴンズ", "タイガース", "ベイスターズ", "ホークス",
    "ファイターズ", "ライオンズ", "マリーンズ", "フットサル", "マラソン", "グランプリ", "m-1", "スポーツフェスティバル", "就活", "就職", "説明会", "展示会", "見本市", "expo", "フェア", "学会", "大会",
    "カップ", "式典", "授与式", "卒業式", "入学式",
)

# News signals.
NEWS_INCLUDE = ("日本公演", "来日", "ジャパンツアー", "追加公演", "アンコール公演", "ドーム", "アリーナ", "開催決定", "先行", "チケット", "公演", "ファンミ", "ライブ", "ツアー", "公演情報")
NEWS_EXCLUDE = ("カムバック", "リリース", "MV", "ドラマ", "映画", "熱愛", "ファッション", "PHOTO", "コスメ")
NEWS_LOCATIONS = ("東京", "大阪", "名古屋", "福岡", "札幌", "横浜", "神戸", "埼玉", "千葉", "京都")

# Regions of prefecture codes, facility order, nights bins, releases, tiers.
REGIONS = {"北海道": (1, 1), "東北": (2, 7), "関東": (8, 14), "中部": (15, 23), "近畿（関西）": (24, 30), "中国": (31, 35), "四国": (36, 39), "九州・沖縄": (40, 47)}
NATIONAL = ("00", "全国")
FACILITY_ORDER = ("計", "旅館", "リゾートホテル", "ビジネスホテル", "シティホテル", "簡易宿所", "会社・団体の宿泊所")
NIGHTS_BINS = ("1泊", "2泊", "3泊", "4泊", "5泊", "6泊", "7泊", "8泊以上")
OPEN_BIN_NIGHTS = 8.5
RELEASES = ("確報", "2次速報", "1次速報")
TIERS = {"S": 0, "A": 1, "B": 2, "reference": 3, "": 4}
LAST_TIER = 9
CONFIDENCE_SCORES = {"high": 95, "medium": 75, "low": 50}

# Text checks.
MOJIBAKE_CODECS = ("ptcp154", "latin1", "cp1252", "shift_jis")
TEXT_FIELDS = ("title", "artist_name", "raw_artist_name", "venue_name", "raw_venue_name", "pref_name", "event_category")

# Prefectures in the order of their codes.
PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県",
    "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県", "福岡県",
    "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
