"""runlens.functions"""
