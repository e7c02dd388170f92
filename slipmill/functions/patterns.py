"""The patterns, words, keys and labels that receipts are read by. They define the results, so they stand as text."""

# --- Fixed values: document kinds, by the words that mark them ---------------------------------------------------
VAT, TRAIN, FLIGHT, UNKNOWN = "vat_invoice", "train_ticket", "flight_itinerary", "unknown"
TOLL_TITLE, TOLL_ENTRY, TOLL_EXIT = "车辆通行费", "入口站", "出口站"
VAT_WORDS, VAT_TOTAL, VAT_TAX = ("发票代码", "发票号码"), "价税合计", "税额"
TRAIN_WORDS = ("车次", "乘车日期")
TRAIN_LINE = r"^\s*[GCDZYKL]\s*[0-9]{1,4}\s*$"
FLIGHT_WORDS = ("行程单", "航班号", "客票号", "承运人", "民航发展基金")

# --- Fixed values: keys and labels of each kind, in order of output -----------------------------------------------
FIELDS = {
    VAT: (("invoice_code", "发票代码"), ("invoice_no", "发票号码"), ("invoice_date", "开票日期"), ("buyer_name", "购买方名称"), ("seller_name", "销售方名称"),
          ("buyer_tax_no", "购买方税号"), ("seller_tax_no", "销售方税号"), ("total_amount", "合计金额"), ("total_tax", "税额"), ("total_amount_with_tax", "价税合计")),
    TRAIN: (("train_no", "车次"), ("travel_date", "乘车日期"), ("price", "票价"), ("passenger_name", "姓名"), ("passenger_id_no", "身份证号"),
            ("seat_class", "席别"), ("from_station", "出发站"), ("to_station", "到达站")),
    FLIGHT: (("flight_no", "航班号"), ("departure", "出发地"), ("arrival", "到达地"), ("flight_date", "航班日期"), ("passenger_name", "乘客姓名"),
             ("ticket_no", "客票号"), ("price", "票价"), ("fuel_surcharge", "燃油附加费"), ("airport_fee", "机场建设费")),
}
CONFIDENCE = 0.8

# --- Fixed values: patterns ---------------------------------------------------------------------------------------
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
VAT_CODE = r"发票\s*[代弋]\s*码\s*[:：]?\s*([0-9A-Za-z\-]{6,})"
VAT_NO = r"发票\s*号码\s*[:：]?\s*([0-9A-Za-z\-]{5,})"
VAT_DATE = r"开票\s*[日目]\s*期\s*[:：]?\s*([0-9]{4})\s*[年\-./]\s*([0-9]{1,2})\s*[月\-./]\s*([0-9]{1,2})\s*[日目]?"
VAT_NAME = r"名(?<!项目名)(?<!货物名)(?<!商品名)(?<!服务名)\s*称\s*[:：]\s*([^\s，,；;]{2,60})"
VAT_NAME_SPLIT = r"(?:^|\n)\s*称\s*[:：]\s*([^\s，,；;]{2,60})(?:\n|$)"
VAT_TAX_NO = r"(?:纳税人.{0,2}号|统一社会信用代码|纳税人识别\s*号)\s*[:：]?\s*([0-9A-Za-z.,/\\|丨·\-]{15,24})"
VAT_SUM_END = r"合\s*计\s*(?:金\s*额)?\s*[:：]?\s*[¥￥]?\s*" + AMOUNT
VAT_SUM = r"(?:价\s*税)?" + VAT_SUM_END
VAT_TAX_SUM = r"税\s*额\s*[:：]?\s*[¥￥]?\s*" + AMOUNT
FIGURES = r"小\s*写((?s:.{0,80}))"
AMOUNT_WITH_DECIMALS = r"([0-9][0-9,]*\.[0-9]{1,2})"
CN_AMOUNT = (r"([零壹贰叁肆伍陆柒捌玖一二三四五六七八九十百千万亿拾佰仟]+)(?:圆|元)(?:整|(?:([零壹贰叁肆伍陆柒捌玖一二三四五六七八九])\s*角)?"
             r"(?:([零壹贰叁肆伍陆柒捌玖一二三四五六七八九])\s*分)?)")
DATE = r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日"
TRAIN_NO = r"(?:车次\s*[:：]?\s*)?([GCDZYKL])\s*([0-9]{1,4})"
PRICE = r"票\s*价\s*[:：]?\s*[¥￥]?\s*" + AMOUNT
PERSON = r"姓\s*名\s*[:：]?\s*([一-龥]{2,4})"
ID_NO = r"([0-9]{17}[0-9Xx])"
SEAT = r"(商务座|特等座|一等座|二等座|高级软卧|软卧|硬卧|软座|硬座|无座|动卧)"
STATION_END = "站"
RUN = r"[一-龥]+"
FLIGHT_NO = r"(?:航班号|航班)\s*[:：]?\s*([A-Z]{2}[0-9]{3,4})"
TICKET_NO = r"客票号\s*[:：]?\s*([0-9A-Za-z]{10,16})"
FUEL = r"燃油\s*附加(?:费)?\s*[:：]?\s*[¥￥]?\s*" + AMOUNT
AIRPORT_FEE = r"(?:机场建设费|民航发展基金)\s*[:：]?\s*[¥￥]?\s*" + AMOUNT
ROUTE = r"[一-龥][一-龥]*\s*(?:[→\-—>]\s*)?[一-龥]"
ARROWS = r"[→\-—>]"

# --- Fixed values: QR payloads --------------------------------------------------------------------------------------
QR_URL = r"""(?i)https?://[^\s"']+"""
QR_DOMAIN = "veri.chinatax.gov.cn"
QR_PARAMETERS = {"fphm": "invoice_no", "kprq": "invoice_date", "jshj": "total_amount_with_tax", "lx": "invoice_type"}
QR_WITH_KIND = (r"^\s*\d{1,2}\s*,\s*\d{1,2}\s*,\s*(\d{0,12})\s*,\s*(\d{8,20})\s*,\s*(\d+(?:\.\d{1,2})?)\s*,\s*(\d{8})\s*(?:,\s*[^,\s]*\s*)?(?:,\s*[^,\s]*\s*)?\s*$")
QR_WITHOUT_KIND = r"^\s*\d{1,2}\s*,\s*(\d{10,12})\s*,\s*(\d{8,20})\s*,\s*(\d+(?:\.\d{1,2})?)\s*,\s*(\d{8})\s*(?:,\s*[^,\s]*\s*)?\s*$"
QR_NO = r"(?:发票号码|号码|NO|No\.?)[:：]?\s*(\d{8,20})"
QR_CODE = r"(?:发票代码|代码|CODE)[:：]?\s*(\d{10,12})"
LOOSE_DATE = r"(\d{4})\D*(\d{1,2})\D*(\d{1,2})"
AMOUNT_KEYS = ("total_amount", "total_tax", "total_amount_with_tax")

# --- Fixed values: numerals and noise -------------------------------------------------------------------------------
DIGITS = ("零壹贰叁肆伍陆柒捌玖", "零一二三四五六七八九")
UNITS = {"拾": 10, "佰": 100, "仟": 1000, "十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
TAX_NO_NOISE = ",./\\|丨-·"

# --- Fixed values: regions of a landscape receipt (x, y, width, height as shares) that hold its fields ----------------
REGIONS = ((0.55, 0.00, 0.45, 0.22), (0.00, 0.18, 0.50, 0.12), (0.50, 0.18, 0.50, 0.12), (0.00, 0.48, 1.00, 0.22), (0.00, 0.72, 1.00, 0.28))
REGION_ASPECT = 1.3
