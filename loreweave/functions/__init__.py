"""loreweave.functions"""
