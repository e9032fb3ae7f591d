"""loreweave.plans"""
