"""Word lists on which results depend, in folded or plain spelling as each rule needs them."""

FIRST_NAMES = (
    "Ahmet Mehmet Mustafa Ali Hüseyin Hasan İbrahim Ömer Yusuf Murat Osman Kemal Orhan Selim Levent Fatih Kenan Hakan Gökhan Serkan "
    "Tolga Onur Barış Cem Ozan Volkan Uğur Engin Sinan Arda Kerem Yiğit Berk Eren Kaan Mert Burak Emre Kadir Ramazan Tarık Sefa Deniz "
    "Can Ege Doruk Bora Koray Selçuk Cenk Tuncay Erdem Görkem Anıl Polat Ayşe Fatma Emine Hatice Zeynep Elif Meryem Sultan Burcu Gül "
    "Sema Selin Defne Nur Ece Pınar Yasemin Esra Merve Büşra Derya Sibel Gamze Ebru Aslı Çağla Dilara Melis İrem Naz Eylül Buse Tuğçe "
    "Özge Gizem Şeyma Beren Ceren Damla Ela Nehir Sıla Duru Azra Zehra Hande Bahar Sevgi"
).split()
NOT_SURNAMES = (
    "Holding Emlak Sigorta Banka Bankası Teknoloji Tekstil İnşaat Otomotiv Bilişim Yazılım Lojistik Sanayi Ticaret Gıda Enerji Turizm "
    "Makine Mobilya Kimya Elektronik Grup Group Şirketi Limited Anonim Mağaza Market Bey Hanım Bay Bayan"
).split()
PROVINCES = (
    "Adana Adıyaman Afyonkarahisar Ağrı Amasya Ankara Antalya Artvin Aydın Balıkesir Bilecik Bingöl Bitlis Bolu Burdur Bursa Çanakkale "
    "Çankırı Çorum Denizli Diyarbakır Edirne Elazığ Erzincan Erzurum Eskişehir Gaziantep Giresun Gümüşhane Hakkari Hatay Isparta Mersin "
    "İstanbul İzmir Kars Kastamonu Kayseri Kırklareli Kırşehir Kocaeli Konya Kütahya Malatya Manisa Kahramanmaraş Mardin Muğla Muş "
    "Nevşehir Niğde Ordu Rize Sakarya Samsun Siirt Sinop Sivas Tekirdağ Tokat Trabzon Tunceli Şanlıurfa Uşak Van Yozgat Zonguldak "
    "Aksaray Bayburt Karaman Kırıkkale Batman Şırnak Bartın Ardahan Iğdır Yalova Karabük Kilis Osmaniye Düzce"
).split()
DISTRICTS = "Kadıköy Beşiktaş Şişli Üsküdar Bakırköy Beyoğlu Maltepe Pendik Çankaya Keçiören Bornova Konak Muratpaşa Nilüfer Osmangazi Selçuklu Çekmeköy Ataşehir Etimesgut".split()
BODIES_AHEAD = "Mahkeme Adliye Valilik Kaymakamlık Belediye Müdürlük Başkanlık Bakanlık Noter Savcılık Müsteşarlık Kurum".split()
INSTITUTION_ROOTS = "MAHKEMES MAHKEMELER ADLIYES VALILIG KAYMAKAMLIG BELEDIYES BUYUKSEHIR MUDURLUG BASKANLIG BAKANLIG MUSTESARLIG NOTERLIG SAVCILIG BASSAVCILIG KURUMU KURULU BIRLIG HEYETI".split()
INSTITUTION_PHRASES = ["KAYIT SISTEM", "NOTERLER BIRLIG", "HAKEM HEYET", "TUKETICI MAHKEMES"]
BLOCKED = [
    *"TC TCKN TCN VKN IBAN KDV TL ₺ API URL IP ID CVC PIN A.Ş A.Ş. LTD LTD. VD MERSİS CAD CAD. SOK SOK. MAH MAH. BLV BLV. NO NO. KAT DAİRE".split(),
    "İÇ KAPI",
    *"SÖZLEŞME MADDE TARAF HİZMET MÜŞTERİ FATURA ÖDEME BANKA HESAP BELGE TEST MASKELEME KURGUSAL BİLGİ TÜRÜ KONU SENARYO".split(),
    "KİRAYA VEREN", "KIRAYA VEREN", "HİZMET ALAN", "HIZMET ALAN", "HİZMET SAĞLAYICI", "HIZMET SAGLAYICI", "RESMİ GAZETE", "RESMI GAZETE",
    *"KVKK FSEK İYUK IYUK GDPR TBMM BDDK MASAK KKDF BSMV ÖTV OTV OLUR AKDİ AKDI TEMERRÜT TEMERRUT MUACCEL BİLEŞİK BILESIK MAHSUP".split(),
    *"ANAPARA MEBLAĞ MEBLAG FERİ FERI TEMİNAT TEMINAT REHİN REHIN TWITTER INSTAGRAM İNSTAGRAM FACEBOOK LINKEDIN LİNKEDİN YOUTUBE WHATSAPP".split(),
    *"TIKTOK TİKTOK TELEGRAM SNAPCHAT PINTEREST PİNTEREST REDDIT REDDİT DISCORD DİSCORD SKYPE ZOOM GOOGLE".split(),
]
BLOCKED_ROOTS = "ŞIRKET BANKA KIRACI ALICI SATICI ISVEREN ISCI TASERON YUKLENICI BORCLU ALACAKLI SIGORTACI SIGORTALI ARACI".split()
GENERIC_TAILS = "ILKE POLITIKA PROSEDÜR SÖZLEŞME TALIMAT YÖNERGE GENELGE RAPOR BELGE DAVRANIŞ TEDARIKÇI ŞARTNAME BEYANNAME TAAHHÜTNAME KILAVUZ STANDART KURAL ETIK GIZLILIK ANLAŞMA PROTOKOL BILDIRIM".split()
LAW_WORDS = r"(?:Kanun|Yönetmel[iİ][kğ]|Tebl[iİ][ğg]|Genelge|Tüzü[kğ]|Kararname|Yönerge|Mevzuat|Anayasa)"
LABELS = (
    "TC_No IBAN Card_No Tax_No Account_No Email Phone_No License_Plate Passport_No Money_Amount Date Case_No Customer_No SGK_No Policy_No "
    "Contract_No Invoice_No Reference_No Person Company Location Address Title Facility IP_Address URL"
).split()
