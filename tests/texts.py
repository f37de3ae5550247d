"""One full text per category, and texts that no category should accept."""

INVOICE = """Northwind Supplies Ltd
TAX INVOICE (VAT invoice)
Invoice Number: NW-88/21   Invoice No NW-88/21   Inv No 21
Invoice Date: 03/11/2024
Due Date: 03/12/2024, payment due within 30 days
Bill To: Blue Door Cafe      Billed To: Blue Door Cafe
Quantity 4, unit price £25.00, line item: chairs
Subtotal: £100.00
VAT: £20.00
Total Amount: £120.00
Amount due £120.00, total due, balance due
Please remit by bank transfer or ACH, remittance advice to accounts, remit to Northwind
Payment Terms: Net 30
PO Number: PO-4471
Supplier: Northwind Supplies Ltd
"""

PURCHASE_ORDER = """PURCHASE ORDER
PO Number: 2024-117, PO No 117, P.O. Number 117, P.O.# 117
Order Number 5001
Order Date: 12/02/2024
Ship To: 4 Harbour Road, Leith
Deliver To the gate, delivery address as above
Ordered By J. Reed, Approved By: Ana Ruiz
Buyer: Lowland Procurement, requisition number: RQ-9, requisition no RQ-9
Order confirmation required. Vendor: Iron & Co Ltd
Supplier list, item number, SKU, quantity, unit price, line total
Total Value: $9,400.50
Shipping terms FOB, delivery date: 01/03/2024
"""

RECEIPT = """Corner Market
RECEIPT - paid, payment received, sale confirmed
Receipt Number: RC-771
Transaction ID: 99-1, transaction number 99, transaction complete
Date: 05/06/2024 14:22
Thank you for your purchase! Thank you for your payment.
Your order has been placed. Your payment has been processed.
Order confirmation, payment confirmation
Total Paid: $18.40, amount paid, cash received, change given, change due 0.00
Store: Corner Market, merchant 12, cashier: Lee, register 3, till 1, POS
Terminal ID 7, authorization code: A1B2C3, card number 1111, Visa, credit card
Subtotal, coupon, qty, item total, grand total, return policy, loyalty points
"""

CONTRACT = """SERVICE AGREEMENT
This Agreement is a contract made between Alder Systems Inc and Birch Holdings LLC.
Effective Date: 1st day of March, 2024
WHEREAS the parties, hereinafter the party of the first part and the party of the second part, agree;
NOW THEREFORE the term, termination, indemnification, force majeure, dispute resolution,
representations and warranties, governing law and entire agreement clauses apply.
Governed by the laws of Scotland.
Confidentiality, liability, amendment, schedule, jurisdiction, arbitration, waiver, notice, fees.
IN WITNESS WHEREOF executed by an authorized signatory.
"""

BANK_STATEMENT = """Caledonian Bank
BANK STATEMENT / ACCOUNT STATEMENT / statement of account
Account Holder: Mary Stone
Account Number: 12345678
Statement Period: 01/04/2024 to date: 30/04/2024
Opening Balance: $100.00
Closing Balance: $250.75, current balance, available balance, ledger balance
Transactions: transaction date, description, reference number, debit, credit, deposits, withdrawals
Branch, sort code, routing number, IBAN, swift code, BIC, overdraft, interest earned,
direct debit, standing order, ATM withdrawal, online banking
Total deposits 400.00, total withdrawals 249.25, brought forward, carried forward
"""

REPORT = """Warehouse Safety Assessment
Report Number: WS-12, Report ID WS-12, report date: 09/09/2024, date of report 09/09/2024
Prepared by: Safety Team, submitted by the board office
Prepared for: Plant Board, submitted to the regulator
Executive Summary, Background, Overview, Scope, Objective, Methodology
Analysis, Findings, Key Findings, Conclusion, Recommendations
Quarterly report with metrics, trend and risk assessment
"""

RESUME = """Dana Whitfield
RESUME / CURRICULUM VITAE (CV)
Email: dana.whitfield@example.org   Phone: (555) 010-2233   mobile
linkedin.com/in/danawhitfield  github.com/danaw  portfolio
Career Objective, objective, career summary, professional summary
Work Experience, professional experience, employment history: 12 years of experience
Job title: Engineer, position, company, employer, responsibilities, achievements, managed, led, developed
Education, academic background: Bachelor degree, university, college, diploma
Qualifications, skills, technical skills, core competencies, certifications, training, awards
References available, references upon request. Volunteer, hobbies, projects, address, city
"""

SAMPLES = {
    "invoice": INVOICE, "purchase_order": PURCHASE_ORDER, "receipt": RECEIPT, "contract": CONTRACT,
    "bank_statement": BANK_STATEMENT, "report": REPORT, "resume": RESUME}

OTHERS = [
    "", " ", "lorem ipsum dolor sit amet", "invoice", "invoice number 5, bill to nobody",
    INVOICE + "\nPayment received. Paid in full.", INVOICE.upper(), RESUME.lower() + " job description",
    "determine the terms: contract parties agreement", "İstanbul ΣΊΣΥΦΟΣ ẞ invoice number bill to"]
