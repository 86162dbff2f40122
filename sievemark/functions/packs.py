"""Rule packs and vocabularies: fixed values that results depend on, stated as they are."""

from __future__ import annotations

#: Rule id, category, language, title, points, regions, pattern.
CONTENT_RULES = (
    ('cred.en.verify', 'Credential phishing', 'en', 'Requests account verification', 18, (), '\\b(verify|validate|confirm|update|unlock)\\b.{0,40}\\b(account|identity|password|login|mailbox)\\b(?!\\s+settings)'),
    ('cred.en.signin', 'Credential phishing', 'en', 'Directs recipient to sign in', 15, (), '\\b(sign[ -]?in|log[ -]?in)\\b.{0,45}\\b(link|below|now|here)\\b'),
    ('cred.zh-hans', 'Credential phishing', 'zh-Hans', 'Requests credential action', 18, ('CN', 'SG'), '(验证|确认|更新|解锁).{0,12}(账户|密码|身份)|点击.{0,8}(登录|链接)'),
    ('cred.zh-hant', 'Credential phishing', 'zh-Hant', 'Requests credential action', 18, ('HK', 'TW'), '(驗證|確認|更新|解鎖).{0,12}(帳戶|密碼|身分)|點擊.{0,8}(登入|連結)'),
    ('cred.ms', 'Credential phishing', 'ms', 'Requests credential action', 18, ('MY', 'SG'), '(sahkan|kemas kini|aktifkan semula).{0,28}(akaun|kata laluan)|klik.{0,18}(log masuk|pautan)'),
    ('cred.id', 'Credential phishing', 'id', 'Requests credential action', 18, ('ID',), '(verifikasi|perbarui|aktifkan kembali).{0,28}(akun|kata sandi)|klik.{0,18}(masuk|tautan)'),
    ('cred.ta', 'Credential phishing', 'ta', 'Requests credential action', 18, ('IN', 'SG', 'LK'), '(சரிபார்க்க|புதுப்பிக்க|உறுதிப்படுத்த).{0,22}(கணக்கு|கடவுச்சொல்)'),
    ('cred.es', 'Credential phishing', 'es', 'Requests credential action', 18, ('ES', 'LATAM'), '(verifi(?:que|car)|actuali(?:ce|zar)|confirme).{0,35}(cuenta|contraseña|identidad|inicio de sesión)'),
    ('cred.fr', 'Credential phishing', 'fr', 'Requests credential action', 18, ('FR', 'CA'), '(vérifi(?:ez|er)|mettre à jour|confirmez).{0,35}(compte|mot de passe|identité|connexion)'),
    ('cred.de', 'Credential phishing', 'de', 'Requests credential action', 18, ('DE', 'AT', 'CH'), '(bestätigen|aktualisieren|überprüfen).{0,35}(konto|passwort|identität|anmeldung)'),
    ('cred.pt', 'Credential phishing', 'pt', 'Requests credential action', 18, ('BR', 'PT'), '(verifi(?:que|car)|atuali(?:ze|zar)|confirme).{0,35}(conta|senha|identidade|login)'),
    ('cred.ar', 'Credential phishing', 'ar', 'Requests credential action', 18, ('MENA',), '(تحقق|تحديث|تأكيد).{0,22}(الحساب|حسابك|كلمة المرور|الهوية)'),
    ('cred.hi', 'Credential phishing', 'hi', 'Requests credential action', 18, ('IN',), '(सत्यापित|अपडेट|पुष्टि).{0,28}(खाता|पासवर्ड|पहचान)|(खाता|पासवर्ड|पहचान).{0,28}(सत्यापित|अपडेट|पुष्टि)'),
    ('cred.bn', 'Credential phishing', 'bn', 'Requests credential action', 18, ('BD', 'IN'), '(যাচাই|আপডেট|নিশ্চিত).{0,28}(অ্যাকাউন্ট|পাসওয়ার্ড|পরিচয়)|(অ্যাকাউন্ট|পাসওয়ার্ড|পরিচয়).{0,28}(যাচাই|আপডেট|নিশ্চিত)'),
    ('cred.ur', 'Credential phishing', 'ur', 'Requests credential action', 18, ('PK',), '(تصدیق|اپ ڈیٹ).{0,28}(اکاؤنٹ|پاس ورڈ|شناخت)|(اکاؤنٹ|پاس ورڈ|شناخت).{0,28}(تصدیق|اپ ڈیٹ)'),
    ('cred.th', 'Credential phishing', 'th', 'Requests credential action', 18, ('TH',), '(ยืนยัน|อัปเดต|ตรวจสอบ).{0,22}(บัญชี|รหัสผ่าน|ตัวตน)'),
    ('cred.vi', 'Credential phishing', 'vi', 'Requests credential action', 18, ('VN',), '(xác minh|cập nhật|xác nhận).{0,28}(tài khoản|mật khẩu|danh tính)'),
    ('cred.ja', 'Credential phishing', 'ja', 'Requests credential action', 18, ('JP',), '(確認|更新|認証).{0,20}(アカウント|パスワード|本人)|(アカウント|パスワード|本人).{0,20}(確認|更新|認証)|リンク.{0,10}(ログイン|サインイン)'),
    ('cred.ko', 'Credential phishing', 'ko', 'Requests credential action', 18, ('KR',), '(확인|업데이트|인증).{0,20}(계정|비밀번호|본인)|(계정|비밀번호|본인).{0,20}(확인|업데이트|인증)|링크.{0,10}(로그인|접속)'),
    ('cred.tl', 'Credential phishing', 'tl', 'Requests credential action', 18, ('PH',), '(beripikahin|i-update|kumpirmahin).{0,30}(account|password|pagkakakilanlan)'),
    ('bec.en.urgent', 'Business email compromise', 'en', 'Urgent payment language', 20, (), '\\b(urgent|confidential)\\b.{0,45}\\b(payment|transfer|invoice|wire)\\b'),
    ('bec.en.bankchange', 'Business email compromise', 'en', 'Requests changed banking details', 28, (), '\\b(change|updated?|new)\\b.{0,32}\\b(bank|banking|payment)\\b.{0,24}\\b(detail|account)s?\\b(?!.{0,30}\\bsettings\\b)'),
    ('bec.en.payroll', 'Business email compromise', 'en', 'Requests a payroll or direct-deposit change', 26, (), '\\b(?:i|we)\\b.{0,20}\\b(?:chang(?:ed|ing)|switch(?:ed|ing)|updat(?:ed|ing)|clos(?:ed|ing))\\b.{0,30}\\b(?:banks?|bank account)\\b|\\b(?:update|change|redirect|switch)\\b.{0,25}\\bmy\\b.{0,20}\\b(?:direct deposit|payroll|paycheck|salary)\\b'),
    ('crypto.en.seedphrase', 'Crypto wallet phishing', 'en', 'Asks for a wallet recovery phrase', 40, (), '\\b(?:seed phrase|recovery phrase|secret recovery phrase|recovery words|mnemonic|12[- ]word|24[- ]word|private key|keystore)\\b.{0,90}\\b(?:verify|confirm|enter|provide|submit|send|restore|validate|reply|share|type|paste)\\b|\\b(?:verify|confirm|enter|provide|submit|send|restore|validate|share|type|paste)\\b.{0,60}\\b(?:seed phrase|recovery phrase|secret recovery phrase|recovery words|mnemonic|12[- ]word|24[- ]word|private key|keystore)\\b'),
    ('crypto.en.walletlocked', 'Crypto wallet phishing', 'en', 'Says a crypto wallet is suspended', 20, (), '\\b(?:your|the)\\s+(?:\\w+\\s+){0,2}wallet\\b.{0,30}\\b(?:suspended|locked|restricted|disabled|frozen)\\b'),
    ('gov.fr.taxrefund', 'Authority impersonation', 'fr', 'Tax-refund lure', 22, ('FR',), '(?:remboursement|rembourser).{0,80}(?:imp[oô]ts?|fisc|dgfip|tr[eé]sor public)|(?:imp[oô]ts?|fisc|dgfip).{0,80}(?:remboursement|rembours[eé])'),
    ('gov.fr.bankdetails', 'Authority impersonation', 'fr', 'Asks for bank details on a deadline', 22, ('FR',), '(?:confirm|renseign|v[eé]rifi|mett|saisi)\\w*.{0,40}coordonn[eé]es bancaires|coordonn[eé]es bancaires.{0,60}(?:avant|dans les|sous)\\s+\\d+\\s*(?:heures|jours)'),
    ('bec.giftcards', 'Business email compromise', 'en', 'Requests gift cards', 25, (), '\\b(gift cards?|itunes|steam cards?|google play cards?)\\b'),
    ('bec.es', 'Business email compromise', 'es', 'Urgent or changed payment request', 24, ('ES', 'LATAM'), '(urgente|confidencial).{0,35}(pago|transferencia|factura)|cambi(?:e|o).{0,25}(datos bancarios|cuenta bancaria)'),
    ('bec.fr', 'Business email compromise', 'fr', 'Urgent or changed payment request', 24, ('FR', 'CA'), '(urgent|confidentiel).{0,35}(paiement|virement|facture)|chang(?:ez|ement).{0,25}(coordonnées bancaires|compte bancaire)'),
    ('bec.de', 'Business email compromise', 'de', 'Urgent or changed payment request', 24, ('DE', 'AT', 'CH'), '(dringend|vertraulich).{0,35}(zahlung|überweisung|rechnung)|geändert.{0,25}(bankdaten|bankkonto)'),
    ('bec.pt', 'Business email compromise', 'pt', 'Urgent or changed payment request', 24, ('BR', 'PT'), '(urgente|confidencial).{0,35}(pagamento|transferência|fatura)|alter(?:e|ação).{0,25}(dados bancários|conta bancária)'),
    ('bec.asia', 'Business email compromise', 'zh-Hans', 'Urgent or changed payment request', 24, ('CN', 'SG'), '(紧急|保密).{0,18}(付款|转账|发票)|更改.{0,12}银行.{0,12}(资料|账户)'),
    ('bec.ms', 'Business email compromise', 'ms', 'Urgent or changed payment request', 24, ('MY', 'SG'), '(segera|sulit).{0,30}(bayaran|pindahan|invois)|ubah.{0,20}(akaun bank|butiran bank)'),
    ('delivery.en', 'Delivery or invoice lure', 'en', 'Delivery problem or fee lure', 16, (), '\\b(parcel|package|shipment|delivery)\\b.{0,38}\\b(fee|failed|pending|reschedul|address)\\b'),
    ('delivery.multi.zh', 'Delivery or invoice lure', 'zh-Hans', 'Delivery problem or fee lure', 16, ('CN', 'SG'), '(包裹|快递|配送).{0,18}(费用|失败|待处理|重新安排|地址)'),
    ('delivery.multi.latam', 'Delivery or invoice lure', 'es', 'Delivery problem or fee lure', 16, ('ES', 'LATAM'), '(paquete|envío|entrega).{0,32}(tarifa|fallid|pendiente|reprogram|dirección)'),
    ('delivery.multi.eu', 'Delivery or invoice lure', 'fr', 'Delivery problem or fee lure', 16, ('FR', 'CA'), '(colis|livraison).{0,30}(frais|échou|suspend|reprogramm|adresse)'),
    ('delivery.multi.de', 'Delivery or invoice lure', 'de', 'Delivery problem or fee lure', 16, ('DE', 'AT', 'CH'), '(paket|lieferung).{0,30}(gebühr|fehlgeschlagen|ausstehend|adresse)'),
    ('delivery.multi.br', 'Delivery or invoice lure', 'pt', 'Delivery problem or fee lure', 16, ('BR', 'PT'), '(encomenda|pacote|entrega).{0,30}(taxa|falhou|pendente|endereço)'),
    ('delivery.multi.asia', 'Delivery or invoice lure', 'ja', 'Delivery problem or fee lure', 16, ('JP',), '(荷物|配達).{0,18}(料金|失敗|保留|再配達|住所)'),
    ('toll.en', 'Toll or traffic-payment scam', 'en', 'Claims an unpaid road or parking charge', 20, ('US', 'CA', 'UK', 'AU', 'SG'), '\\b(unpaid|overdue)\\b.{0,30}\\b(toll|parking|traffic (?:ticket|fine))\\b|\\b(toll|parking fine)\\b.{0,30}\\b(pay now|penalty)'),
    ('toll.es', 'Toll or traffic-payment scam', 'es', 'Claims an unpaid road or parking charge', 20, ('ES', 'LATAM'), '(peaje|multa de tráfico|estacionamiento).{0,30}(impag|pagar|recargo)'),
    ('tax.multi', 'Tax or refund scam', 'en', 'Unexpected tax refund or rebate', 20, ('US', 'UK', 'AU', 'CA'), '\\b(tax refund|rebate|irs refund|hmrc refund|ato refund|cra refund)\\b.{0,45}\\b(claim|pending|click|bank details|fee)'),
    ('tax.es', 'Tax or refund scam', 'es', 'Unexpected tax refund or rebate', 20, ('ES', 'LATAM'), '(reembolso|devolución).{0,24}(impuesto|hacienda).{0,35}(reclamar|datos bancarios|tasa)'),
    ('utility.en', 'Utility or telecom scam', 'en', 'Threatens utility or telecom disconnection', 20, (), '\\b(electricity|power|gas|internet|mobile service)\\b.{0,40}\\b(disconnect|suspend|overdue|immediate payment)'),
    ('subscription.en', 'Subscription or renewal scam', 'en', 'Unexpected subscription renewal or refund', 18, (), '\\b(subscription|antivirus|membership)\\b.{0,35}\\b(renewed|renewal|charged|refund)\\b.{0,50}\\b(call|contact|cancel)'),
    ('job.en', 'Job or task scam', 'en', 'High-reward job or task offer', 18, (), '\\b(part[ -]?time|remote job|simple tasks?|product review)\\b.{0,60}\\b(commission|earn|salary|whatsapp|telegram)\\b'),
    ('job.deposit', 'Job or task scam', 'en', 'Task scam deposit cycle', 26, (), '\\b(top[ -]?up|recharge|deposit)\\b.{0,45}\\b(task|commission|withdraw)'),
    ('job.asia', 'Job or task scam', 'zh-Hans', 'Job or task scam language', 24, ('CN', 'SG'), '(兼职|刷单|任务).{0,20}(佣金|赚钱|充值|提现)'),
    ('job.ms', 'Job or task scam', 'ms', 'Job or task scam language', 24, ('MY', 'SG'), '(kerja sambilan|tugasan).{0,32}(komisen|pendapatan|deposit|tambah nilai)'),
    ('job.id', 'Job or task scam', 'id', 'Job or task scam language', 24, ('ID',), '(kerja paruh waktu|tugas|ulas produk).{0,32}(komisi|penghasilan|deposit|isi saldo)'),
    ('job.hi', 'Job or task scam', 'hi', 'Job or task scam language', 24, ('IN',), '(पार्ट.?टाइम|घर से काम|टास्क).{0,28}(कमीशन|कमाई|जमा|रिचार्ज)'),
    ('investment.en', 'Investment or crypto scam', 'en', 'Promises guaranteed investment returns', 25, (), '\\b(guaranteed|risk[ -]?free)\\b.{0,35}\\b(return|profit|investment|crypto)|\\bdouble your (?:money|bitcoin)\\b'),
    ('investment.es', 'Investment or crypto scam', 'es', 'Promises guaranteed investment returns', 25, ('ES', 'LATAM'), '(rentabilidad|ganancia).{0,25}(garantizada|sin riesgo)|duplica.{0,16}(dinero|bitcoin)'),
    ('investment.zh', 'Investment or crypto scam', 'zh-Hans', 'Promises guaranteed investment returns', 25, ('CN', 'SG'), '(保证|稳赚|零风险).{0,18}(收益|回报|投资|加密货币)|杀猪盘'),
    ('investment.pt', 'Investment or crypto scam', 'pt', 'Promises guaranteed investment returns', 25, ('BR', 'PT'), '(retorno|lucro).{0,24}(garantido|sem risco)|duplique.{0,16}(dinheiro|bitcoin)'),
    ('romance.en', 'Romance scam', 'en', 'Romantic trust paired with a money emergency', 24, (), '\\b(love you|soulmate|future together)\\b.{0,120}\\b(emergency|hospital|customs|ticket|send money|gift card)'),
    ('romance.es', 'Romance scam', 'es', 'Romantic trust paired with a money emergency', 24, ('ES', 'LATAM'), '(te amo|alma gemela|futuro juntos).{0,120}(emergencia|hospital|aduana|billete|envía dinero)'),
    ('recovery.en', 'Recovery scam', 'en', 'Offers recovery of lost funds for an upfront fee', 28, (), '\\b(recover|retrieve|get back)\\b.{0,35}\\b(lost|stolen|scammed)\\b.{0,45}\\b(funds|money|crypto)\\b.{0,45}\\b(upfront|fee|payment)'),
    ('recovery.es', 'Recovery scam', 'es', 'Offers recovery of lost funds for an upfront fee', 28, ('ES', 'LATAM'), '(recuperar).{0,35}(fondos|dinero|cripto).{0,45}(tasa|pago por adelantado|anticipo)'),
    ('gov.en', 'Government or law-enforcement impersonation', 'en', 'Government or police threat paired with payment', 28, (), '\\b(irs|hmrc|police|federal agent|social security|immigration|court)\\b.{0,70}\\b(arrest|warrant|deport|fine|gift card|crypto|transfer)'),
    ('gov.india', 'Government or law-enforcement impersonation', 'en', 'Digital-arrest or authority impersonation language', 30, ('IN',), '\\b(digital arrest|cbi officer|customs officer|narcotics parcel)\\b'),
    ('gov.zh-hant', 'Government or law-enforcement impersonation', 'zh-Hant', 'Government or police threat paired with payment', 28, ('HK', 'TW'), '(警察|入境處|稅務局|法院).{0,35}(拘捕|通緝|罰款|轉帳)'),
    ('bank.en', 'Bank or payment-service impersonation', 'en', 'Bank alert directs recipient to take action', 22, (), '\\b(bank|paypal|wallet|card)\\b.{0,38}\\b(blocked|suspended|unauthori[sz]ed|fraud)\\b.{0,45}\\b(click|verify|reverse|secure)'),
    ('tech.en', 'Tech-support or malware scam', 'en', 'False security alert requests support access', 25, (), '\\b(virus|infected|security alert|hacker)\\b.{0,45}\\b(call|remote access|anydesk|teamviewer|support)'),
    ('mule.en', 'Money-mule recruitment', 'en', 'Recruits recipient to move money', 28, (), '\\b(receive|process|forward)\\b.{0,30}\\b(payments?|funds?|transfers?)\\b.{0,40}\\b(commission|keep \\d+%|your account)'),
    ('friend.en', 'Friend or family impersonation', 'en', 'Friend or family emergency payment request', 24, (), '\\b(new (?:phone|number)|lost my phone|mum|mom|dad|daughter|son)\\b.{0,70}\\b(urgent|bill|money|transfer|whatsapp)'),
    ('friend.pt', 'Friend or family impersonation', 'pt', 'Friend or family emergency payment request', 24, ('BR',), '(número novo|celular novo|mãe|pai|filho|filha).{0,70}(urgente|boleto|pix|transferência)'),
    ('prize.en', 'Prize or advance-fee scam', 'en', 'Unexpected prize or funds requires payment', 24, (), '\\b(winner|won|lottery|prize|inheritance)\\b.{0,70}\\b(fee|claim|release|processing|tax)'),
    ('prize.multi', 'Prize or advance-fee scam', 'es', 'Unexpected prize or funds requires payment', 24, ('ES', 'LATAM'), '(ganador|lotería|premio|herencia).{0,55}(tasa|reclamar|liberar|impuesto)'),
    ('charity.en', 'Charity or disaster scam', 'en', 'Donation request uses hard-to-reverse payment', 20, (), '\\b(donate|donation|relief fund|victims?)\\b.{0,50}\\b(crypto|gift card|wire|personal account)'),
    ('loan.en', 'Loan or debt scam', 'en', 'Loan or debt offer requires an upfront fee', 24, (), '\\b(guaranteed loan|debt relief|loan approved)\\b.{0,45}\\b(upfront fee|processing fee|gift card|crypto)'),
    ('immigration.en', 'Immigration or visa scam', 'en', 'Visa or immigration promise/threat requires payment', 24, (), '\\b(visa|immigration|residency|work permit)\\b.{0,45}\\b(guaranteed|approved|avoid deportation|processing fee)'),
    ('extortion.en', 'Extortion or threat', 'en', 'Coercive demand for payment', 28, (), '\\b(compromising|webcam|recorded you|expose|leak)\\b.{0,80}\\b(bitcoin|crypto|pay|wallet)'),
    ('qr.en.verify', 'Credential phishing', 'en', 'Asks the recipient to scan a QR code to verify or sign in', 22, (), '\\bscan\\b.{0,30}\\b(qr|barcode)\\b.{0,90}\\b(verify|re-?enrol\\w*|re-?enroll\\w*|authenticate|sign[ -]?in|log[ -]?in|update|activate|unlock|secure)\\b|\\b(qr code)\\b.{0,70}\\b(to (?:verify|re-?enrol\\w*|re-?enroll\\w*|authenticate|sign in|log in)|below to)\\b'),
    ('lock.en', 'Credential phishing', 'en', 'Threatens to lock or close the account unless the recipient acts', 15, (), "\\b(failure to|unless you|if you (?:do not|don't)|otherwise|to avoid|or (?:your|the)) .{0,70}\\b(locked|suspended|closed|disabled|frozen|blocked|deactivated|terminated|permanently)\\b"),
    ('cred.ms.identity', 'Credential phishing', 'ms', 'Requests credential action', 18, ('MY', 'SG'), '(sahkan|semak|kemas kini|sahkan semula).{0,30}(identiti|maklumat|akaun|kad|kata laluan)'),
    ('lock.ms', 'Credential phishing', 'ms', 'Threatens to suspend or close the account', 18, ('MY', 'SG'), '(akaun|kad|akses).{0,40}(digantung|disekat|dibekukan|dikunci|ditutup|dibatalkan)|(elak|mengelakkan|untuk mengelak).{0,25}(penutupan|penggantungan|sekatan)'),
    ('cred.id.identity', 'Credential phishing', 'id', 'Requests credential action', 18, ('ID',), '(verifikasi|konfirmasi|perbarui|segera verifikasi).{0,30}(identitas|akun|rekening|kartu|data)'),
    ('lock.id', 'Credential phishing', 'id', 'Threatens to suspend or close the account', 18, ('ID',), '(rekening|akun|kartu|akses).{0,40}(diblokir|dibekukan|ditangguhkan|dinonaktifkan|ditutup)|(hindari|menghindari|agar tidak).{0,25}(penutupan|pemblokiran|penangguhan)'),
    ('cred.ar.identity', 'Credential phishing', 'ar', 'Requests credential action', 18, ('MENA',), '(تحقق|التحقق|تأكيد|تحديث).{0,30}(هويتك|حسابك|بياناتك|بطاقتك|معلوماتك)'),
    ('lock.ar', 'Credential phishing', 'ar', 'Threatens to suspend or close the account', 18, ('MENA',), '(حسابك|بطاقتك|الوصول).{0,30}(تجميد|مجمد|مجمّد|موقوف|إيقاف|معلق|تعليق|محظور|إغلاق|مغلق)|(تم|سيتم)\\s+(تجميد|إيقاف|تعليق|إغلاق)\\s+(حسابك|بطاقتك)'),
    ('cred.ru', 'Credential phishing', 'ru', 'Requests credential action', 18, (), '(подтвердите|проверьте|подтвердить|обновите|верифицируйте|пройдите верификацию).{0,40}(личность|аккаунт|карт[ыуа]?|данные|счёт|счет|пароль)'),
    ('lock.ru', 'Credential phishing', 'ru', 'Threatens to suspend or close the account', 18, (), '(карта|карты|счёт|счет|аккаунт|доступ).{0,40}(заблокирован\\w*|заморожен\\w*|приостановлен\\w*|ограничен\\w*)|(во избежание|чтобы избежать).{0,30}(блокировк\\w*|закрыт\\w*)'),
)

#: Rule id, category, title, points, mapping, pattern.
TACTIC_RULES = (
    ('oauth.consent', 'OAuth consent phishing', 'Requests OAuth application consent', 28, 'MITRE ATT&CK T1566.002/T1528', '\\b(grant|approve|authorize|consent to)\\b.{0,55}\\b(permission|access)\\b.{0,45}\\b(app|application|mailbox|files?|tenant)\\b'),
    ('identity.device-code', 'Device-code phishing', 'Directs the recipient through a device-code sign-in flow', 28, 'MITRE ATT&CK T1566.002', '\\b(device code|verification code)\\b.{0,70}\\b(enter|use|visit|sign[ -]?in|microsoft|google)\\b|\\b(microsoft\\.com/devicelogin|google\\.com/device)\\b'),
    ('identity.mfa-push', 'MFA fatigue or approval phishing', 'Requests approval of an MFA or login prompt', 25, 'MITRE ATT&CK T1621', '\\b(mfa|multi[ -]?factor|authenticator|push notification|login request)\\b.{0,70}\\b(approve|accept|allow|verify|number matching)\\b'),
    ('identity.session-token', 'Session-token phishing', 'Uses a session or SSO reauthentication lure', 22, 'MITRE ATT&CK T1539/T1550.004', '\\b(session (?:expired|token|cookie)|reauthenticate|re-authenticate|keep me signed in|single sign[ -]?on)\\b.{0,70}\\b(sign[ -]?in|login|verify|continue|restore)\\b'),
    ('execution.clickfix', 'ClickFix or command-execution lure', 'Instructs the recipient to paste or execute a command', 42, 'MITRE ATT&CK T1204.002/T1059', '\\b(windows\\s*\\+\\s*r|run dialog|powershell|terminal|command prompt)\\b.{0,120}\\b(paste|execute|run|ctrl\\s*\\+\\s*v)\\b|\\bcopy.{0,40}(command|script).{0,40}(run|terminal|powershell)\\b'),
    ('remote.rmm', 'Remote-access tool lure', 'Requests installation or use of remote-access software', 34, 'MITRE ATT&CK T1219', '\\b(anydesk|teamviewer|screenconnect|connectwise|logmein|rustdesk|quick assist|remote desktop)\\b.{0,80}\\b(install|download|open|allow|code|session)\\b'),
    ('cloud.share', 'Cloud-document phishing', 'Cloud document or signature lure requires account action', 20, 'MITRE ATT&CK T1566.002/T1566.003', '\\b(sharepoint|onedrive|google drive|dropbox|docusign|adobe sign)\\b.{0,80}\\b(shared|document|file|signature)\\b.{0,80}\\b(sign[ -]?in|verify|view|open)\\b'),
    ('otp.request', 'One-time-code theft', 'Asks the recipient to disclose a one-time code', 32, 'MITRE ATT&CK T1111', '\\b(otp|one[ -]?time (?:password|code)|verification code|security code)\\b.{0,70}\\b(reply|send|share|provide|tell)\\b|\\b(reply|send|share|provide).{0,50}\\b(otp|verification code)\\b'),
    ('qr.login', 'QR login phishing', 'Uses a QR code for authentication or payment action', 24, 'MITRE ATT&CK T1566.002', '\\b(scan|open)\\b.{0,30}\\b(qr|quick response)\\b.{0,70}\\b(sign[ -]?in|login|verify|mfa|authenticate|payment)\\b'),
)

#: Title, points, pattern.
GENERIC_RULES = (
    ('Uses urgency or time pressure', 8, '\\b(urgent|immediately|within 24 hours|act now|final warning)\\b|紧急|立即|緊急|segera|அவசரம்|urgente|immédiatement|dringend|عاجل|तुरंत|জরুরি|فوری|ด่วน|khẩn cấp|至急|긴급|kagyat|\\bexpires? (?:today|tomorrow|in \\d+ (?:hours?|minutes?))\\b|dalam masa \\d+ jam|dalam \\d+ jam|в течение \\d+ час\\w*|срочно|немедленно|خلال \\d+ ساعة'),
    ('Uses a generic greeting', 5, '\\b(dear customer|dear user|valued customer)\\b|尊敬的客户|尊敬的客戶|pelanggan yang dihargai|estimado cliente|cher client|sehr geehrter kunde|prezado cliente|عزيزي العميل|प्रिय ग्राहक|প্রিয় গ্রাহক|محترم صارف|เรียนลูกค้า|kính gửi quý khách|お客様|고객님|mahal na customer|pelanggan yang dihormati|nasabah yang terhormat|уважаемый клиент|уважаемый пользователь'),
    ('Discourages independent verification', 15, '\\bdo not (call|contact|tell|discuss)\\b|不要(联系|告诉)|不要(聯絡|告訴)|jangan (hubungi|beritahu)|no (llame|contacte|cuente)|ne (contactez|dites)|nicht (anrufen|kontaktieren)|لا (تتصل|تخبر)'),
    ('Prompts the recipient to open content', 7, '\\b(click|open|follow)\\b.{0,25}\\b(link|button|attachment)\\b|点击.{0,10}(链接|按钮)|點擊.{0,10}(連結|按鈕)|klik.{0,15}(pautan|tautan|butang)|haga clic.{0,15}(enlace|botón)|cliquez.{0,15}(lien|bouton)|klicken.{0,15}(link|schaltfläche)'),
)

#: Patterns that take a match back when they stand shortly before it.
NEGATIONS = (
    "\\b(do not|don't|never|no need to|will not)\\b",
    '不要|无需|無需|jangan|tidak perlu',
    '\\b(no (?:debe|necesita)|nunca|ne (?:devez|faut) pas|niemals|nicht erforderlich)\\b',
    '\\b(não (?:precisa|clique)|nunca)\\b|لا (?:تضغط|حاجة)|ضرورت نہیں',
    'வேண்டாம்|नहीं|করবেন না|อย่า|không (?:cần|nhấp)|しないで|하지 마|huwag',
)

#: Languages by code.
LANGUAGES = {
    'en': 'English',
    'zh-Hans': 'Simplified Chinese',
    'zh-Hant': 'Traditional Chinese',
    'ms': 'Malay',
    'id': 'Indonesian',
    'ta': 'Tamil',
    'es': 'Spanish',
    'fr': 'French',
    'de': 'German',
    'pt': 'Portuguese',
    'ar': 'Arabic',
    'hi': 'Hindi',
    'bn': 'Bengali',
    'ur': 'Urdu',
    'th': 'Thai',
    'vi': 'Vietnamese',
    'ja': 'Japanese',
    'ko': 'Korean',
    'tl': 'Filipino/Tagalog',
    'ru': 'Russian',
}

#: Words that speak for a language.
LANGUAGE_MARKERS = {
    'en': (' your ', ' account', 'please ', 'payment', 'click '),
    'zh-Hans': ('账户', '验证', '点击', '付款', '紧急', '包裹'),
    'zh-Hant': ('帳戶', '驗證', '點擊', '付款', '緊急', '包裹'),
    'ms': ('akaun', 'sila', 'pautan', 'bayaran', 'segera', 'bungkusan'),
    'id': ('akun', 'silakan', 'tautan', 'pembayaran', 'segera', 'paket'),
    'ta': ('கணக்கு', 'வங்கி', 'சரிபார்க்க', 'பணம்', 'அவசரம்'),
    'es': ('cuenta', 'verifique', 'contraseña', 'pago', 'urgente', 'paquete'),
    'fr': ('compte', 'vérifiez', 'mot de passe', 'paiement', 'immédiatement', 'colis'),
    'de': ('konto', 'bestätigen', 'passwort', 'zahlung', 'dringend', 'paket'),
    'pt': ('conta', 'verifique', 'senha', 'pagamento', 'urgente', 'encomenda'),
    'ar': ('حساب', 'تحقق', 'كلمة المرور', 'دفع', 'عاجل', 'طرد'),
    'hi': ('खाता', 'सत्यापित', 'पासवर्ड', 'भुगतान', 'तुरंत', 'पार्सल'),
    'bn': ('অ্যাকাউন্ট', 'যাচাই', 'পাসওয়ার্ড', 'পেমেন্ট', 'জরুরি', 'পার্সেল'),
    'ur': ('اکاؤنٹ', 'تصدیق', 'پاس ورڈ', 'ادائیگی', 'فوری', 'پارسل'),
    'th': ('บัญชี', 'ยืนยัน', 'รหัสผ่าน', 'ชำระ', 'ด่วน', 'พัสดุ'),
    'vi': ('tài khoản', 'xác minh', 'mật khẩu', 'thanh toán', 'khẩn cấp', 'bưu kiện'),
    'ja': ('アカウント', '確認', 'パスワード', '支払い', '緊急', '荷物'),
    'ko': ('계정', '확인', '비밀번호', '결제', '긴급', '택배'),
    'tl': ('beripikahin', 'iyong account', 'bayad', 'kagyat', 'padala', 'gcash'),
    'ru': ('аккаунт', 'подтвердите', 'пароль', 'оплата', 'срочно', 'посылка', 'заблокирована', 'клиент'),
}

#: Scripts that speak for a language.
SCRIPT_HINTS = {
    'ta': '[\\u0b80-\\u0bff]',
    'hi': '[\\u0900-\\u097f]',
    'bn': '[\\u0980-\\u09ff]',
    'th': '[\\u0e00-\\u0e7f]',
    'ja': '[\\u3040-\\u30ff]',
    'ko': '[\\uac00-\\ud7af]',
    'ru': '[\\u0400-\\u04ff]',
}

#: Label and substrings by region.
REGIONS = {
    'SG': ('Singapore', ('singpass', 'cpf', 'iras', 'paynow', 'scamshield', 'lta', 'ica singapore')),
    'MY': ('Malaysia', ('lhdn', 'jpj', 'pdrm', "touch 'n go", 'tng ewallet', 'maybank')),
    'ID': ('Indonesia', ('ojk', 'kominfo', 'bca', 'bri', 'dana', 'gopay', 'pinjol')),
    'HK': ('Hong Kong', ('入境處', '香港警務處', '強積金', 'mpf', '轉數快', 'fps')),
    'AU': ('Australia', ('mygov', 'ato', 'medicare', 'centrelink', 'linkt')),
    'NZ': ('New Zealand', ('ird', 'nzta', 'wakat kotahi', 'realme')),
    'US': ('United States', ('irs', 'social security', 'usps', 'ez-pass', 'medicare')),
    'CA': ('Canada', ('cra', 'service canada', 'canada post', 'interac')),
    'UK': ('United Kingdom', ('hmrc', 'dvla', 'nhs', 'royal mail', 'tv licence')),
    'IN': ('India', ('upi', 'aadhaar', 'pan card', 'income tax department', 'digital arrest', 'cbi officer')),
    'JP': ('Japan', ('マイナンバー', '国税庁', '日本郵便', '再配達')),
    'KR': ('South Korea', ('국세청', '경찰청', '택배', '과태료')),
    'BR': ('Brazil', ('pix', 'receita federal', 'boleto', 'correios', 'gov.br')),
    'LATAM': ('Latin America', ('hacienda', 'aduana', 'mercado pago', 'whatsapp', 'transferencia bancaria')),
    'MENA': ('Middle East / North Africa', ('إقامة', 'الهوية الوطنية', 'وزارة الداخلية', 'مخالفة مرورية', 'زكاة')),
    'AFRICA': ('Sub-Saharan Africa', ('mobile money', 'm-pesa', 'business grant', 'airtime', 'mo momo')),
    'PH': ('Philippines', ('gcash', 'maya wallet', 'sss', 'bir', 'philpost')),
}

#: Brands and the domains they own.
BRANDS = {
    'apple': ('apple.com', 'icloud.com'),
    'amazon': ('amazon.ca', 'amazon.co.jp', 'amazon.co.uk', 'amazon.com', 'amazon.com.au', 'amazon.de', 'amazon.in', 'amazon.jobs', 'amazon.sg', 'amazonaws.com'),
    'google': ('g.co', 'gmail.com', 'goo.gl', 'google.ca', 'google.co.uk', 'google.com', 'google.com.au', 'google.com.sg', 'google.de', 'googleapis.com', 'googlemail.com', 'googleusercontent.com', 'gstatic.com', 'youtube.com'),
    'microsoft': ('azure.com', 'bing.com', 'live.com', 'microsoft.com', 'microsoftonline.com', 'msn.com', 'office.com', 'office365.com', 'outlook.com', 'sharepoint.com', 'skype.com', 'windows.com'),
    'paypal': ('paypal.com', 'paypal.me', 'paypalobjects.com'),
    'dhl': ('dhl.co.uk', 'dhl.com', 'dhl.com.sg', 'dhl.de'),
    'fedex': ('fedex.com',),
    'singpost': ('singpost.com',),
    'dbs': ('dbs.com', 'dbs.com.sg'),
    'posb': ('dbs.com.sg', 'posb.com.sg'),
    'ocbc': ('ocbc.com',),
    'uob': ('uob.com.sg', 'uobgroup.com'),
    'mas': ('mas.gov.sg',),
    'govtech': ('govtech.gov.sg',),
    'singpass': ('singpass.gov.sg',),
    'iras': ('iras.gov.sg',),
    'cpf': ('cpf.gov.sg',),
    'moh': ('moh.gov.sg',),
}

#: Characters read as others.
CONFUSABLES = {
    'а': 'a',
    'ɑ': 'a',
    'α': 'a',
    'е': 'e',
    'ε': 'e',
    'ё': 'e',
    'і': 'i',
    'ι': 'i',
    'ӏ': 'l',
    'ⅼ': 'l',
    'Ӏ': 'l',
    'ο': 'o',
    'о': 'o',
    'ρ': 'p',
    'р': 'p',
    'ѕ': 's',
    'с': 'c',
    'ϲ': 'c',
    'τ': 't',
    'т': 't',
    'υ': 'u',
    'ν': 'v',
    'ѵ': 'v',
    'х': 'x',
    'у': 'y',
    'ʏ': 'y',
    'ԁ': 'd',
    'ԛ': 'q',
    'ց': 'g',
    'һ': 'h',
    'ｍ': 'm',
    'ｗ': 'w',
    '０': '0',
    '１': '1',
    '３': '3',
    '５': '5',
}

#: Words that make a brand name a lure.
LURE_WORDS = (
    'account',
    'accounts',
    'alert',
    'alerts',
    'billing',
    'care',
    'center',
    'centre',
    'confirm',
    'customer',
    'delivery',
    'help',
    'helpdesk',
    'id',
    'info',
    'invoice',
    'login',
    'logon',
    'mail',
    'official',
    'online',
    'pay',
    'payment',
    'payments',
    'portal',
    'recovery',
    'refund',
    'reset',
    'secure',
    'security',
    'service',
    'services',
    'signin',
    'support',
    'team',
    'track',
    'tracking',
    'update',
    'verify',
    'verification',
    'wallet',
    'web',
    'webmail',
)

#: Sample sentences by category.
PROTOTYPES = {
    'Credential phishing': ['verify account password login immediately', 'mailbox suspended sign in to restore access', '验证账户密码点击登录', 'sahkan akaun kata laluan klik log masuk', 'கணக்கு கடவுச்சொல் சரிபார்க்க'],
    'Business email compromise': ['urgent confidential wire transfer invoice change bank details', 'buy gift cards and send the codes', '紧急转账更改银行资料', 'segera pindahan ubah butiran bank'],
    'Delivery or invoice lure': ['package delivery failed pay small fee reschedule', 'invoice remittance purchase order attached', '包裹配送失败支付费用', 'penghantaran gagal bayar yuran'],
    'Job or task scam': ['remote part time job simple task commission deposit withdraw', 'product review task top up to unlock earnings', '兼职刷单任务佣金充值提现', 'kerja sambilan tugasan komisen deposit'],
    'Prize or advance-fee scam': ['lottery winner prize inheritance processing release fee', '中奖奖品领取手续费'],
    'Extortion or threat': ['recorded webcam compromising video pay bitcoin wallet or expose', 'blackmail cryptocurrency demand'],
    'Investment or crypto scam': ['guaranteed risk free investment return double your money crypto profit', 'ganancia garantizada inversión sin riesgo', 'lucro garantido investimento bitcoin', '保证稳赚零风险投资收益'],
    'Government or law-enforcement impersonation': ['police federal agent arrest warrant transfer money', 'digital arrest customs officer narcotics parcel', '警察拘捕通缉罚款转账'],
    'Bank or payment-service impersonation': ['bank card blocked unauthorized payment click verify account', 'wallet suspended secure your account'],
    'Tech-support or malware scam': ['computer infected virus call support remote access anydesk teamviewer'],
    'Romance scam': ['love soulmate future together emergency hospital send money gift card', 'te amo alma gemela emergencia envía dinero'],
    'Recovery scam': ['recover stolen crypto lost funds upfront fee', 'recuperar fondos tasa pago por adelantado'],
    'Friend or family impersonation': ['new phone number mum dad urgent bill transfer money', 'número novo pix urgente mãe pai'],
    'Toll or traffic-payment scam': ['unpaid toll parking traffic fine pay now penalty'],
    'Tax or refund scam': ['tax refund rebate pending claim bank details fee'],
}

#: Link shorteners.
SHORTENERS = (
    'bit.ly',
    'buff.ly',
    'cutt.ly',
    'goo.gl',
    'is.gd',
    'ow.ly',
    'rb.gy',
    'rebrand.ly',
    'shorturl.at',
    't.co',
    'tiny.cc',
    'tinyurl.com',
)

#: Parameters that hold a redirect.
REDIRECT_KEYS = (
    'continue',
    'dest',
    'destination',
    'next',
    'redirect',
    'redirect_to',
    'redirect_uri',
    'return',
    'return_to',
    'target',
    'url',
)

#: Endings of file names, not of hosts.
FILE_SUFFIXES = (
    'apk',
    'asp',
    'aspx',
    'bat',
    'csv',
    'dat',
    'dll',
    'dmg',
    'doc',
    'docm',
    'docx',
    'eml',
    'exe',
    'gif',
    'gz',
    'htm',
    'html',
    'ics',
    'img',
    'iso',
    'jpeg',
    'jpg',
    'js',
    'json',
    'lnk',
    'msg',
    'msi',
    'pdf',
    'php',
    'png',
    'ppt',
    'pptx',
    'py',
    'rar',
    'sh',
    'svg',
    'tar',
    'txt',
    'xls',
    'xlsm',
    'xlsx',
    'xml',
    'zip',
)

#: Hosts where anyone can publish.
USER_CONTENT_HOSTS = (
    'docs.google.com',
    'forms.gle',
    'script.google.com',
    'sites.google.com',
    'storage.googleapis.com',
)

#: Endings of programs and scripts.
EXECUTABLE_SUFFIXES = (
    '.appinstaller',
    '.bat',
    '.chm',
    '.cmd',
    '.com',
    '.dll',
    '.exe',
    '.hta',
    '.img',
    '.iso',
    '.jar',
    '.js',
    '.jse',
    '.lnk',
    '.msix',
    '.one',
    '.ps1',
    '.reg',
    '.scr',
    '.url',
    '.vbe',
    '.vbs',
    '.vhd',
    '.vhdx',
    '.wim',
    '.xlam',
    '.xll',
)

#: Fixed values of the sample similarity: blanks between single letters that are drawn together, and what parts words.
LETTER_GAPS = r"(?:(?<=\b\w)\s+(?=\w\b)){2,}"
WORD_BREAKS = r"[^\w\u3400-\u9fff\u0b80-\u0bff]+"
