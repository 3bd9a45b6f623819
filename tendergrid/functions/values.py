"""Words, names and patterns of the data itself, which results depend on."""

# What counts as no value, month names, legal forms, the joint-venture marker, methods of purchase.
NULL_WORDS = ("", "-", "nan", "none", "null", "nat", "n/a", "na", "undefined")
MONTHS = {
    "ม.ค.": 1, "ก.พ.": 2, "มี.ค.": 3, "เม.ย.": 4, "พ.ค.": 5, "มิ.ย.": 6,
    "ก.ค.": 7, "ส.ค.": 8, "ก.ย.": 9, "ต.ค.": 10, "พ.ย.": 11, "ธ.ค.": 12,
    "มกราคม": 1, "กุมภาพันธ์": 2, "มีนาคม": 3, "เมษายน": 4, "พฤษภาคม": 5, "มิถุนายน": 6,
    "กรกฎาคม": 7, "สิงหาคม": 8, "กันยายน": 9, "ตุลาคม": 10, "พฤศจิกายน": 11, "ธันวาคม": 12,
}
LEGAL_FORMS = ("บริษัทจำกัด", "บริษัท", "ห้างหุ้นส่วนจำกัด", "ห้างหุ้นส่วนสามัญ", "หจก.", "หสม.", "บมจ.", "บจก.", "ร้าน")
JV_MARKER = "สัญญากิจการค้าร่วม"
SPECIFIC_METHOD = "เฉพาะเจาะจง"
EBIDDING_METHOD = "ประกวดราคาอิเล็กทรอนิกส์ (e-bidding)"

# Patterns of work groups in project names, the first that fits wins.
WORK_GROUPS = (
    ("leak", r"แตกรั่ว|จุดรั่ว|น้ำสูญเสีย|ซ่อมท่อ"),
    ("staff", r"บุคคลภายนอก|ปฏิบัติงาน|ลูกจ้าง|พนักงาน|แรงงานรายวัน|คนงาน|\d+\s*อัตรา|[๐-๙]+\s*อัตรา|จ้างเหมาบริการบุคคล"),
    ("service", r"รักษาความปลอดภัย|ทำความสะอาด|อินเตอร์เน็ต|อินเทอร์เน็ต|เครือข่าย|VPN|โปรแกรม|ซอฟต์แวร์|ระบบบริหาร|เอกสาร|เก็บตัวอย่างน้ำ|ตรวจวิเคราะห์|ห้องปฏิบัติการ|ที่ปรึกษา|ออกแบบ|ควบคุมงาน|ประกันภัย|ประชาสัมพันธ์|พิมพ์|จัดเก็บรายได้|ดูแลสวน|ภูมิทัศน์"),
    ("chemical", r"คลอรีน|สารส้ม|PAC|โพลีอะลูมิเนียม|ปูนขาว|สารเคมี|วัสดุวิทยาศาสตร์|น้ำยา|โซดาไฟ|กรดไฮโดร|ไฮโดรคลอริก"),
    ("meter", r"มาตรวัดน้ำ|มิเตอร์"),
    ("road", r"(ก่อสร้าง|ปรับปรุง|ซ่อมแซม|ซ่อมสร้าง|บูรณะ)\s*(ผิว)?\s*ถนน|ถนน\s*(คอนกรีต|ลาดยาง|ลูกรัง|หินคลุก|แอสฟัล|คสล|ค\.ส\.ล)|ผิวจราจร|ลาดยาง|แอสฟัลท์ติก|แอสฟัลต์ติก|คืนสภาพผิว"),
    ("source", r"บาดาล|ขุดลอก|ขุดสระ|สระน้ำ|สระเก็บน้ำ|ฝาย|อ่างเก็บน้ำ|แหล่งน้ำดิบ|น้ำดิบ"),
    ("tower", r"หอถัง|หอประปา|ถังสูง|ถังเก็บน้ำ|ถังพักน้ำ|หอสูง|ถังแชมเปญ|ถังเหล็ก|บ่อพักน้ำ|ถังน้ำใส"),
    ("plant", r"ผลิตน้ำ|กรองน้ำ|ถาดเติมอากาศ|ถังกรอง|โรงกรอง|โรงผลิต|ตกตะกอน|น้ำดื่ม|อาร์โอ|สารกรอง|ทรายกรอง|กรวดกรอง"),
    ("energy", r"เครื่องสูบ|ปั๊ม|ปั้ม|มอเตอร์|พลังงานแสงอาทิตย์|โซลาร์|โซล่า|ไฟฟ้า|หม้อแปลง|ตู้ควบคุม"),
    ("pipe", r"วางท่อ|ขยายเขต|ท่อส่งน้ำ|ท่อจ่ายน้ำ|ท่อเมน|แนวท่อ|เดินท่อ|เปลี่ยนท่อ|ย้ายท่อ|ระบบท่อ|เส้นท่อ|ท่อ\s*(PVC|HDPE|พีวีซี|เหล็ก|พีอี)|เชื่อมต่อระบบ"),
    ("material", r"ซื้อวัสดุ|วัสดุประปา|วัสดุก่อสร้าง|อุปกรณ์ประปา|ครุภัณฑ์|อะไหล่|ซื้อท่อ"),
    ("repair", r"ซ่อม|ปรับปรุง|บำรุงรักษา|ฟื้นฟู|ย้าย"),
    ("build", r"ก่อสร้าง|ติดตั้ง|จัดทำระบบประปา|ระบบประปา"),
)
# What all names share (the way of purchase at their end, the act at their start), where phrases part, and the signs that
# can't end or begin a word.
NAME_TAIL = r"(?s)(ด้วยวิธี|โดยวิธี).*$"
NAME_LEAD = r"(?U)^\s*(ประกวดราคา|สอบราคา|ประกาศ)?\s*(จัดซื้อจัดจ้าง|จัดซื้อ|จัดจ้าง|ซื้อ|จ้างเหมา|จ้าง|เช่า)?\s*(งาน|โครงการ)?\s*"
PHRASE_ENDS = r"(?U)[\s()\"'“”/,]+"
NO_WORD_END = "[เแโใไ่้๊๋์]+$"
NO_WORD_START = "^[ะัาำิีึืุู็่้๊๋์ๆฯๅ]+"
# Purposes, all that fit are kept.
PURPOSES = (
    ("expand", "ขยายเขต|เพิ่มกำลัง|ขยายกำลัง|ก่อสร้างระบบประปา|ขยายท่อ|เพิ่มประสิทธิภาพการผลิต"),
    ("maintain", "ซ่อม|ปรับปรุง|บำรุงรักษา|ฟื้นฟู|เปลี่ยนท่อ|เปลี่ยนอุปกรณ์|ทดแทน"),
    ("nrw", "น้ำสูญเสีย|แตกรั่ว|จุดรั่ว|DMA|สำรวจหาน้ำ"),
    ("quality", "คลอรีน|สารส้ม|สารกรอง|ทรายกรอง|ตรวจวิเคราะห์|คุณภาพน้ำ|น้ำดื่ม"),
    ("urgent", "ภัยแล้ง|ฉุกเฉิน|เร่งด่วน|อุทกภัย|ประสบภัย|ขาดแคลนน้ำ"),
    ("admin", "จ้างเหมาบุคคล|บุคคลภายนอก|รักษาความปลอดภัย|ทำความสะอาด|ที่ปรึกษา|สำรวจออกแบบ|ประชาสัมพันธ์|เช่าบริการ|อ่านมาตร"),
)
# Parts of project names.
ANATOMY = (
    ("method", r"ด้วยวิธี|โดยวิธี"),
    ("village", r"หมู่ที่\s*[\d๐-๙]|หมู่\s*[\d๐-๙]|บ้าน[ก-ฮ]"),
    ("admin", r"ตำบล|ต\.[ก-ฮ]|อำเภอ|อ\.[ก-ฮ]|จังหวัด|จ\.[ก-ฮ]"),
    ("size", r"ขนาด|Ø|เส้นผ่า|ศก\.|มม\.|นิ้ว"),
    ("length", r"ความยาว|ระยะทาง|[\d,๐-๙.]+\s*(เมตร|ม\.|กม\.|กิโลเมตร)"),
    ("volume", r"ลบ\.?ม|ลูกบาศก์เมตร|ความจุ"),
    ("qty", r"จำนวน\s*[\d๐-๙,]+\s*(แห่ง|ชุด|ตัว|เครื่อง|อัตรา|ราย|จุด|หน่วย|รายการ)"),
    ("year", r"ปีงบประมาณ|พ\.ศ\.\s*[๒2]"),
    ("again", r"ครั้งที่\s*[๒-๙2-9]"),
)
# How agencies are classed by the start of their names.
AGENCY_CLASSES = (
    ("องค์การบริหารส่วนตำบล", "อบต."), ("เทศบาลตำบล", "เทศบาลตำบล"), ("เทศบาลเมือง", "เทศบาลเมือง"), ("เทศบาลนคร", "เทศบาลนคร"),
    ("องค์การบริหารส่วนจังหวัด", "อบจ."), ("การประปา", "การประปา"), ("กรม", "ราชการส่วนกลาง"), ("กระทรวง", "ราชการส่วนกลาง"),
    ("สำนักงาน", "ราชการส่วนกลาง"), ("มหาวิทยาลัย", "สถานศึกษา"), ("โรงเรียน", "สถานศึกษา"), ("โรงพยาบาล", "สาธารณสุข"),
)
OTHER_AGENCY = "อื่นๆ"
# The raw columns of an exported contract file.
RAW_COLUMNS = (
    "project_id", "project_name", "project_type_name", "dept_name", "dept_sub_name", "purchase_method_name", "purchase_method_group_name",
    "province", "district", "subdistrict", "winner_tin", "winner_name", "contract_no", "project_money", "price_build", "sum_price_agree",
    "contract_price_agree", "announce_date", "contract_date", "contract_finish_date", "project_location", "budget_year",
)
# Surfaces of roads by patterns of their names, in order, and works whose price covers more than the road.
SURFACES = (("rc", r"คอนกรีตเสริมเหล็ก|ค\.?ส\.?ล|คสล"), ("asphalt", r"แอสฟัล|ลาดยาง"), ("gravel", r"ลูกรัง|หินคลุก"))
OTHER_SURFACE = "other"
COMBINED_SCOPE = r"ท่อระบาย|รางวี|รางระบาย|บ่อพัก|ท่อลอด|ระบายน้ำ"
CONSTRUCTION_TYPE = "จ้างก่อสร้าง"
# Amounts of money that a file may be sorted by, sizes at which exports stop, and words of a search.
SORT_FIELDS = ("sum_price_agree", "contract_price_agree", "project_money", "price_build")
EXPORT_CAPS = (1000, 2000, 5000, 10000, 20000, 50000)
SEARCH_WORDS = ("ประปา", "น้ำ", "ถนน", "ก่อสร้าง")
